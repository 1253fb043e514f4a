import random

from helpers import documents, prose, save

from millrace.llm import licence

HELD_OUT = {
    "apache-2.0": ["This project is Licensed under the Apache License, Version 2.0", "Code released under the apache license 2.0."],
    "mit": ["This software is released under the MIT License", "Distributed under the terms of the MIT License."],
    "gpl": ["This program is free software; you can redistribute it and modify it under the terms of the GNU General Public License", "it is licensed under the GNU General Public License, version 3"],
    "lgpl": ["You can redistribute this library under the terms of the GNU Lesser General Public License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "mpl-2.0": ["This file is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-sa": ["Text is licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["Photos are Licensed under CC BY-NC 4.0."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal"],
    "proprietary": ["Copyright 2020 The Authors. All rights reserved."],
}
OTHER = ["My driver license was lost", "The public general library has a new version", "permission to leave was given", "He has a license to fish in the commons", "apache tribes of the south", "copyright", "", "the terms of the contract", "MIT is a school in Massachusetts", "All of our rights are in danger"]


def test_held_out_paragraphs():
    model = licence.train()
    rows = [(f, t) for f, texts in HELD_OUT.items() for t in texts]
    assert sum(model.judge(t)[0] == f for f, t in rows) >= 0.9 * len(rows)
    assert all(model.judge(t)[0] == licence.UNKNOWN for t in OTHER)


def brute(text):
    model = licence.train()
    found = {}
    for paragraph in licence.paragraphs((text or "").lower()):
        family, p, _ = model.judge(paragraph)
        if family != licence.UNKNOWN:
            found[family] = max(p, found.get(family, 0.0))
    return sorted(found), min(found.values(), default=None)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    notices = [t for texts in [*licence.TEMPLATES.values(), *HELD_OUT.values()] for t in texts] + OTHER
    texts = [None, "", "\n\n", *notices]
    for _ in range(60):
        texts.append("\n".join(rng.choice(notices) if rng.random() < 0.4 else prose(rng, 9) for _ in range(rng.randrange(1, 6))))
    rows = [*enumerate(texts), (0, texts[5]), (None, texts[6])]
    folder = save(documents(spark, rows).withColumnRenamed("source", "key"), tmp_path, "documents")
    got = licence.op9_licence(spark, folder).collect()
    expected = sorted(((i, ",".join(brute(t)[0]), len(brute(t)[0]), brute(t)[1]) for i, t in rows), key=str)
    found = sorted(((r.doc_id, r.licences, r.n_families, r.least_probability) for r in got), key=str)
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert all(a is b or abs(a - b) < 2e-6 for (*_, a), (*_, b) in zip(found, expected, strict=True))


NOTICES = {
    "mit": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "apache-2.0": " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at",
    "agpl": "it under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


def test_wrapped_notices_have_their_family_alone(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 30)}\n\n{t}\n\n{prose(rng, 30)}") for i, t in enumerate(NOTICES.values())]
    found = {r.doc_id: r.licences for r in licence.scan(documents(spark, rows)).collect()}
    assert found == dict(enumerate(NOTICES))


def test_other_licences_are_unknown_or_their_own():
    model = licence.train()
    assert [model.judge(t)[0] for t in ("SPDX-License-Identifier: ISC", "Licensed under the Boost Software License 1.0", "Licensed under the GNU Affero General Public License")] == ["isc", "bsl-1.0", "agpl"]
    others = ["European Union Public Licence 1.2", "Artistic License 2.0", "Microsoft Public License", "Common Development and Distribution License 1.0", "zlib License", "Academic Free License 3.0", "SIL Open Font License 1.1", "Open Software License 3.0"]
    for name in others:
        for t in ("Licensed under the {}.", "Released under the {}", "This program is licensed under the terms of the {}."):
            assert model.judge(t.format(name))[0] == licence.UNKNOWN, t.format(name)
    for tag in ("Zlib", "EUPL-1.2", "Artistic-2.0", "CDDL-1.0", "OFL-1.1"):
        assert model.judge(f"SPDX-License-Identifier: {tag}")[0] == licence.UNKNOWN


def test_very_long_and_repeated_texts(spark):
    long = "\n".join(["plain words here"] * 50_000 + ["Released under the MIT License."])
    found = sorted((r.doc_id, r.licences) for r in licence.scan(documents(spark, [(1, long), (1, long), (2, long.replace("\n", " "))])).collect())
    assert found[:2] == [(1, "mit"), (1, "mit")] and found[2][1] in ("", "mit")


def test_empty_table_and_no_python(spark):
    out = licence.scan(documents(spark, []))
    assert out.count() == 0
    plan = licence.scan(documents(spark, [(1, "Released under the MIT License.")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lines_without_a_trigger_reach_no_template():
    for words in ("released under the new one", "mit dem wunder", "in source and binary forms with or without modification are met", "version 2.0 of the thing"):
        assert licence.train().judge(words)[0] == licence.UNKNOWN
    notices = [t for texts in licence.TEMPLATES.values() for t in texts]
    assert all(any(all(h in t.lower() for h in hint) for hint in licence.HINTS) for t in notices)
