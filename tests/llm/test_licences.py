"""Licence notices that no template holds word for word, and what tells families apart."""

import pytest

from quillspark.llm.licences import TEMPLATES, licence_scan

HELD_OUT = [
    ("gpl-3.0", "Distributed under the terms of the GNU General Public License v3.0"),
    ("gpl-3.0", "This file is part of Frobnicate, which is free software under the GNU GPL v3 or later."),
    ("gpl-2.0", "You can redistribute this module under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl-2.1", "This library is distributed under the terms of the GNU Lesser General Public License, version 2.1 or later."),
    ("lgpl-2.1", "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3.0", "The bindings are available under the GNU Lesser General Public License version 3."),
    ("agpl-3.0", "Server code: GNU Affero General Public License v3.0."),
    ("apache-2.0", "This software is made available under the terms of the Apache License, Version 2.0."),
    ("apache-2.0", "Code in this directory is covered by the Apache 2.0 license."),
    ("bsd-3-clause", "License: BSD 3-Clause"),
    ("bsd-3-clause", "Use of this source code is governed by the BSD 3-Clause License found in the LICENSE file."),
    ("bsd-2-clause", "Distributed under the BSD 2-Clause License, see LICENSE."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Distributed under the MIT license, see accompanying file."),
    ("mit", "This module may be used under the terms of the MIT Licence."),
    ("cc-by-4.0", "The text is available under the Creative Commons Attribution 4.0 International Licence."),
    ("cc-by-sa-4.0", "Content on this site is available under CC BY-SA 4.0 unless noted otherwise."),
    ("cc-by-nc-sa-4.0", "Slides are published under CC BY-NC-SA 4.0"),
    ("eupl-1.2", "The European Union Public Licence v1.2 applies to this work"),
    ("mpl-2.0", "This file is licensed under the Mozilla Public License 2.0; see MPL.txt."),
    ("isc", "All code here is available under the ISC license."),
    ("gpl", "Redistributed under the GNU General Public License."),
    ("unknown", "Licensed under the Qorvex License, version 4."),
    ("unknown", "Released under the Tavil Nordel License."),
    ("apache-2.0", "# Copyright 2020 The Vex Authors. Licensed under the Apache License, Version 2.0. See LICENSE for details."),
    ("apache-2.0", "The examples are provided under Apache License 2.0, as is the documentation."),
    ("mit", "Copyright (c) 2018 Ros Tur. MIT License."),
    ("mit", "tinyparse is open source and available under the MIT License"),
    ("mit", "License: MIT License"),
    ("bsd-2-clause", "All rights reserved. Provided under the Simplified BSD License."),
    ("bsd-3-clause", "Copyright 2011 Kin Lo, dual-purpose code under the New BSD License"),
    ("bsd-3-clause", "Neither the name of Acme Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-3-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-2.0", "Linux-style drivers in here are released under GPL v2."),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-3.0", "frob is licensed under the GNU General Public License, version 3 (or any later one)."),
    ("lgpl-2.1", "Licensed under LGPL v2.1"),
    ("lgpl", "This plugin is covered by the GNU Lesser General Public License."),
    ("lgpl-3.0", "Released under the GNU LGPL v3."),
    ("agpl-3.0", "The hosted service is published under the AGPL v3."),
    ("mpl-2.0", "Portions are subject to the Mozilla Public License 2.0."),
    ("cc-by-nc-4.0", "Figures licensed CC BY-NC 4.0 by the authors."),
    ("cc-by-nd-4.0", "The essay is licensed under CC BY-ND 4.0."),
    ("cc0-1.0", "The data set has been released under CC0 1.0 Universal."),
    ("isc", "Copyright Mer Nov, ISC License"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("eupl-1.2", "Licensed under the EUPL v1.2"),
    ("unknown", "This work is licensed under the Bagam Public License, version 7."),
    ("unknown", "SPDX-License-Identifier: Corvex-2.0"),
]
CLEAN = [
    "Apache helicopters flew over the gnu herd in version 2 of the film.",
    "The general public was admitted under licence 3 at the public library.",
    "He lost his driving licence in 2019.",
    "The MIT campus is open to visitors and the software foundation met there.",
    "Attribution of the 4.0 magnitude quake to the fault is international news.",
]


def scan(spark, texts):
    rows = licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_held_out_notices(spark):
    got = scan(spark, [t for _, t in HELD_OUT])
    hits = [list(r.licences) == [k] for r, (k, _) in zip(got, HELD_OUT, strict=True)]
    assert sum(hits) >= 0.95 * len(hits)
    # A notice of another family is worse than none: nothing is confirmed as what it is not.
    assert all(set(r.licences) <= {k, "unknown"} for r, (k, _) in zip(got, HELD_OUT, strict=True))
    assert [list(r.licences) for r in scan(spark, CLEAN)] == [[]] * len(CLEAN)


def test_probabilities_of_held_out_notices(spark):
    """Mean probability and share of right results agree within a tenth."""
    got = [(r.best_share, list(r.licences) == [k]) for r, (k, _) in zip(scan(spark, [t for _, t in HELD_OUT]), HELD_OUT, strict=True) if r.licences]
    assert abs(sum(p for p, _ in got) / len(got) - sum(h for _, h in got) / len(got)) < 0.1


LESSER = "This library is licensed under the GNU Lesser General Public License, version {}."
AFFERO = "This work is licensed under the GNU Affero General Public License, version {}."


@pytest.mark.parametrize("around", ["{}", "Some words before it. {} And many words of another matter after it, about the sea."])
def test_versions_and_kinds(spark, around):
    cases = [
        ("lgpl-2.1", LESSER.format("2.1")), ("lgpl-3.0", LESSER.format(3)), ("unknown", LESSER.format(7)), ("agpl-3.0", AFFERO.format(3)), ("unknown", AFFERO.format(2)),
        ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."), ("unknown", "This work is licensed under the GNU General Public License, version 1."),
        ("bsd-2-clause", "Released under the BSD 2-Clause License."), ("bsd-3-clause", "Released under the BSD 3-Clause License."), ("unknown", "Released under the BSD 4-Clause License."),
        ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."), ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ]
    got = scan(spark, [around.format(t) for _, t in cases])
    assert [list(r.licences) for r in got] == [[k] for k, _ in cases]


def test_shared_sentences(spark):
    clause = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    got = scan(spark, [clause, clause + "\n\nReleased under the BSD 2-Clause License.", "Released under the GNU General Public License.", "Released under the MIT License.", None, ""])
    assert [(list(r.licences), list(r.possible)) for r in got] == [
        (["bsd-3-clause"], ["bsd-2-clause", "bsd-3-clause"]), (["bsd-2-clause"], []), (["gpl"], ["gpl-2.0", "gpl-3.0"]), (["mit"], []), ([], []), ([], []),
    ]


def test_long_text_repeats_and_clashing_names(spark):
    notice = LESSER.format("2.1")
    long = "word " * 200_000 + notice + " other" * 200_000
    d = spark.createDataFrame([(1, long, "x", 0.5), (1, long, "y", 0.1), (None, notice, None, None)], "doc_id long, text string, licences string, best_share double")
    got = licence_scan(d).collect()
    assert sorted((r.doc_id or -1, list(r.licences)) for r in got) == [(-1, ["lgpl-2.1"]), (1, ["lgpl-2.1"]), (1, ["lgpl-2.1"])]


def test_templates_name_their_family(spark):
    got = scan(spark, [t for _, t in TEMPLATES])
    assert [list(r.licences) for r in got] == [[k] for k, _ in TEMPLATES]


def test_two_names_in_one_line(spark):
    got = scan(spark, ["Licensed under the MIT License or the ISC License.", "Released under the MIT License.\tLicensed under the Apache License, Version 2.0."])
    assert [list(r.licences) for r in got] == [["isc", "mit"], ["apache-2.0", "mit"]]
