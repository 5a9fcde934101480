"""Real notices that the licence scan hasn't seen in this form: recall of each family, and what no family covers."""

import textwrap

import pytest

from loomline.llm import license_scan
from loomline.llm._shared import table

GNU = "{p} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
WARRANTY = "{p} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
ASF = "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The Foundation licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
TEXTS = {
    "agpl-3.0": [GNU.format(p="Tidewater", n="Affero General Public License", v=3), "Tidewater is released under the AGPL-3.0.", "// SPDX-License-Identifier: AGPL-3.0-or-later", 'license = "AGPL-3.0-only"'],
    "apache-2.0": [ASF, "Code is Apache-2.0, docs are not.", "# SPDX-License-Identifier: Apache-2.0", "This library is made available under the Apache License, Version 2.0, which can be found in LICENSE."],
    "bsd": [BSD, "/* Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. */", 'license: "BSD-3-Clause"', "Covered by the 2-Clause text, that is, the Simplified BSD License."],
    "cc-by-4.0": ["Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International License. Please credit us.", "Data: CC BY 4.0", "Figures (c) the authors, CC-BY-4.0.", "Text under Creative Commons Attribution 4.0 (see legal code)."],
    "cc-by-nc-4.0": ["The recordings are licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Audio: CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "Photos under Creative Commons Attribution-NonCommercial 4.0."],
    "cc-by-sa-4.0": ["Wiki pages are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Maps: CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text under Creative Commons Attribution-ShareAlike 4.0."],
    "gpl-2.0": [GNU.format(p="Lantern", n="General Public License", v=2), "Lantern may be copied under the GNU General Public License, version 2.", "; SPDX-License-Identifier: GPL-2.0", 'MODULE_LICENSE("GPLv2");'],
    "gpl-3.0": [GNU.format(p="Lantern", n="General Public License", v=3), "Lantern may be copied under the GNU General Public License v3.0.", "%% SPDX-License-Identifier: GPL-3.0-or-later", "license: GPLv3"],
    "isc": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Harbour is under the ISC License", "// SPDX-License-Identifier: ISC", '"license": "ISC"'],
    "lgpl-2.1": [GNU.format(p="This library", n="Lesser General Public License", v="2.1"), "Linked under the GNU LGPL v2.1 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later", "The wrapper is LGPL-2.1."],
    "mit": [MIT, "This project uses the MIT License (see LICENSE.txt).", "-- SPDX-License-Identifier: MIT", '"license": "MIT"'],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.", "Distributed under MPL 2.0", "SPDX-License-Identifier: MPL-2.0", "Add-on code: Mozilla Public License, version 2.0."],
}
FORMS = [
    lambda t: t,
    lambda t: "\n".join(textwrap.wrap(t, 60)),
    lambda t: "\n".join(f"# {x}" for x in textwrap.wrap(t, 44)),
    lambda t: f"/*\n * Harbour tools, second edition.\n *\n * {t}\n */",
    lambda t: f"A first line of plain text\n{t}\nAnd the story went on from there.",
    lambda t: t.upper(),
    lambda t: f"Copyright 2017 Ines Marek. {t} Send remarks to the list.",
]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return license_scan.train(table(spark, "documents")(sf_dir))


@pytest.mark.parametrize("family", sorted(TEXTS))
def test_recall_of_each_family(model, family):
    texts = [form(t) for t in TEXTS[family] for form in FORMS]
    found = [{f for _, f, _ in x} for x in model.scan([t.encode() for t in texts])]
    assert sum(family in f for f in found) / len(texts) >= 0.9, [t for t, f in zip(texts, found) if family not in f]
    assert sum(bool(f - {family, "unknown"}) for f in found) / len(texts) <= 0.05, [(t, f) for t, f in zip(texts, found) if f - {family, "unknown"}]


def test_what_no_family_covers(model):
    texts = ["Licensed under the Foo Vendor License, version 9.", "SPDX-License-Identifier: Zlib", "Released under the Harbour Community License", "This work is licensed under the Tidewater Agreement.", "GNU General Public License"]
    assert [[f for _, f, _ in x] for x in model.scan([t.encode() for t in texts])] == [["unknown"]] * len(texts)
    plain = ["You need a licence to fish here.", "She had permission to use the hall.", WARRANTY.format(p="x")[:30], "the terms of the sale", "", "Version 2.0 of the map"]
    assert [[f for _, f, _ in x if f != "unknown"] for x in model.scan([t.encode() for t in plain])] == [[]] * len(plain)


def test_places_choices_and_neighbours(model):
    scan = lambda t: [(n, f) for n, f, _ in model.scan([t.encode()])[0]]
    assert scan("One\n\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nTwo") == [(2, "mit"), (3, "apache-2.0")]
    assert sorted(scan("Dual-licensed under the MIT License or the Apache License, Version 2.0")) == [(0, "apache-2.0"), (0, "mit")]
    assert scan("x " * 50_000 + "\n" + "Released under the MIT License. " + "y " * 50_000) == [(1, "mit")]
    assert scan("Apache License,\nVersion 2.0.") == [(0, "apache-2.0")]
    assert scan("Apache License,\n\nVersion 2.0.") != [(0, "apache-2.0")]
