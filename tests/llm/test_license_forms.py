"""License scans: forms, whole texts, negations, and the ranking against compressing by hand."""

import zstandard

from trackweave.llm import license_scan as L

T = L.TEMPLATES
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n{}. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n{}. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
THIRD = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
FORMS = {
    "license: Apache-2.0": "Apache-2.0",
    'license = "MIT"': "MIT",
    "licensed under the GPL v2": "GPL-2.0",
    "GNU GPL version 3": "GPL-3.0",
    "MIT License\n\nCopyright (c) 2020 A B": "MIT",
    "The MIT License (MIT)\nCopyright 2020": "MIT",
    "                              Apache License\n                        Version 2.0, January 2004\n                     http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "Apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Licensed under CC BY 3.0.": "CC-BY-3.0",
    "license: CC0-1.0": "CC0-1.0",
    T["Zlib"][0]: "Zlib",
    T["Unlicense"][0]: "Unlicense",
    BSD.format(1, 2): "BSD-2-Clause",
    BSD.format("*", "*").replace("*.", "*"): "BSD-2-Clause",
    BSD.format(1, 2) + THIRD: "BSD-3-Clause",
    BSD.split("\n\n")[0]: "BSD",
    "This file is not licensed under the MIT License.": "",
    "This file isn't released under the MIT License.": "",
    "students of MIT hold the copyright": "",
    "the licence of the club: MIT graduates only": "",
    "licensed under the Apache License, Version 1.1.": "",
}


def test_forms(spark):
    keys = list(FORMS)
    rows = [(i, x) for i, k in enumerate(keys) for x in (k,)] + [(100 + i, f"some words before\n{k}\nand behind them") for i, k in enumerate(keys)]
    got = {r["doc_id"]: r["licenses"] for r in L.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: got[i] for i, k in enumerate(keys)} == FORMS
    assert {k: got[100 + i] for i, k in enumerate(keys)} == FORMS


def test_ranking_is_by_size_reduction():
    """Of all templates, the one whose dictionary makes a block smallest is tried first; the confirmed one is the best whose wording is there."""
    for name, whole in (("BSD-3-Clause", T["BSD-3-Clause"][1]), ("BSD-2-Clause", T["BSD-2-Clause"][1]), ("LGPL-3.0", T["LGPL-3.0"][0]), ("GPL-3.0", T["GPL-3.0"][1]), ("MIT", T["MIT"][2])):
        block, size = whole.rstrip("."), {}  # a window ends with a word
        for license_, wordings in T.items():
            for w in wordings:
                d = zstandard.ZstdCompressionDict(w.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size[license_, w] = len(zstandard.ZstdCompressor(level=9, dict_data=d, write_content_size=False).compress(block.encode()))
        plain = len(zstandard.ZstdCompressor(level=9, write_content_size=False).compress(block.encode()))
        fits = [k for k in size if L._same_license(k[1], block) is not None]
        best = min(fits, key=lambda k: size[k])
        _, found = L.notices(block)
        assert [f[1] for f in found] == [name] == [best[0]]
        assert abs(found[0][2] - (plain - size[best]) / plain) < 1e-9
