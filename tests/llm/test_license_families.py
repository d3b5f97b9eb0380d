"""Known license sentences in their original punctuation, and both readings of one text."""

import re

import pytest

from pressloom.llm import licenses

LATER = "either version {} of the License, or (at your option) any later version."
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
    "(the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or "
    "substantial portions of the Software.\n"
)


def gnu(work, license, version, marks=(":", ",")):
    return (
        f"# This {work} is free software{marks[0]} you can redistribute it and/or modify\n# it under the terms of the {license} as published by\n"
        f"# the Free Software Foundation{marks[1]} {LATER.format(version)}\n#\n# This {work} is distributed in the hope that it will be useful,\n"
        f"# but WITHOUT ANY WARRANTY.  See the\n# {license} for more details.\n#\n"
        f"# You should have received a copy of the {license}\n# along with this {work}.  If not, see <https://www.gnu.org/licenses/>.\n"
    )


def bsd(holder):
    clauses = [
        "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the "
        "documentation\n   and/or other materials provided with the distribution.",
    ]
    if holder:
        clauses.append(
            f"Neither the name of {holder} nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
            "   this software without specific prior written permission."
        )
    head = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    return head + "\n\n".join(f"{n}. {c}" for n, c in enumerate(clauses, start=1)) + "\n"


GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
NOTICES = [
    ("// SPDX-License-Identifier: MIT\nint main() {}", "MIT"),
    ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("// SPDX-License-Identifier: GPL-3.0-only\n", "GPL-3.0-only"),
    ("// SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later"),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n", "GPL-2.0-only"),
    ("Words. SPDX-License-Identifier: (MIT OR Apache-2.0)\nmore", "Apache-2.0,MIT"),
    ("// SPDX-License-Identifier: BSD-3-Clause AND ISC AND MPL-2.0", "BSD-3-Clause,ISC,MPL-2.0"),
    ("// SPDX-License-Identifier: CC0-1.0 OR Unlicense OR LGPL-2.1-or-later OR AGPL-3.0-only", "AGPL-3.0-only,CC0-1.0,LGPL-2.1-or-later,Unlicense"),
    (gnu("program", GPL, 2, (";", ";")), "GPL-2.0-or-later"),
    (gnu("program", GPL, 3), "GPL-3.0-or-later"),
    (gnu("library", LGPL, 2.1, (";", ";")), "LGPL-2.1-or-later"),
    (gnu("library", LGPL, 3), "LGPL-3.0-or-later"),
    (gnu("program", AGPL, 3), "AGPL-3.0-or-later"),
    (f"This program is free software; you can redistribute it and/or modify\nit under the terms of the {GPL} version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only"),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0",
    ),
    (
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, "
        "provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC",
    ),
    (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\n"
        "distribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
        "Unlicense",
    ),
    (
        "To the extent possible under law, the author(s) have dedicated all\ncopyright and related and neighboring rights to this software to the\n"
        "public domain worldwide. This software is distributed without any warranty.\n\nYou should have received a copy of the CC0 Public Domain "
        "Dedication along\nwith this software.", "CC0-1.0",
    ),
    (bsd("Google Inc."), "BSD-3-Clause"),
    (bsd("the University of Somewhere, Dept. of\n   Things"), "BSD-3-Clause"),
    (bsd("the copyright holder"), "BSD-3-Clause"),
    (bsd(None), "BSD-2-Clause"),
    ("# This file is licensed under the MIT license.\nimport os", "MIT"),
    ("Distributed under the terms of the MIT license", "MIT"),
    ("Words.\nReleased under the Apache-2.0 license.\nWords.", "Apache-2.0"),
    ("This software is available under the BSD 3-Clause License.", "BSD-3-Clause"),
    ('name: thing\nlicense: MIT\nversion: 1', "MIT"),
    ('{\n  "license": "x",\n# License: "Apache-2.0"\n', "Apache-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file)", "BSL-1.0"),
    ("// SPDX-License-Identifier: Zlib\n", "Zlib"),
    ("// SPDX-License-Identifier: EPL-2.0 OR BSL-1.0\n", "BSL-1.0,EPL-2.0"),
    ("It was released under MIT rules and neither the name nor the place is known. Licensed under the mittens license", ""),
    ("Ordinary words about free software: you may like it. With v. 2 or without.", ""),
]


@pytest.fixture
def scanned(spark):
    def run(*texts):
        rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        return [r for _, r in sorted((r.doc_id, r) for r in rows)]

    return run


def test_notices_in_their_own_punctuation(scanned):
    rows = scanned(*[t for t, _ in NOTICES])
    assert [(r.licenses, r.n_unmatched) for r in rows] == [(name, 0) for _, name in NOTICES]


#: The original marks of sentences: what stands where the plain words of SENTENCES have a blank.
MARKS = [
    ("this program is free software you", "This program is free software: you"),
    ("software foundation either", "Software Foundation; either"), ("or at your option any", "or (at your option) any"), ("and or ", "and/or "),
    ("files the software to", 'files (the "Software"), to'), ("version 2 0 the license", 'Version 2.0 (the "License")'), (" 2 0", " 2.0"),
    (" 4 0", " 4.0"), ("the mit license mit", "The MIT License (MIT)"), ("license version", "License, Version"),
    ("granted free of charge to", "granted, free of charge, to"), ("use copy modify merge publish distribute sublicense", "use, copy, modify, merge, publish, distribute, sublicense,"),
    ("binary forms with or without modification are", "binary forms, with or without modification, are"), ("notice this list", "notice, this list"),
    (" v 2.0", ", v. 2.0"), ("more details", "more\n * details"),
]


def test_every_sentence_with_its_marks_is_known(scanned):
    texts = []
    for s in licenses.KNOWN:
        if s.startswith("spdx license identifier "):
            name = re.sub(r"([0-9]) ([0-9])", r"\1.\2", s.removeprefix("spdx license identifier "))
            s = "SPDX-License-Identifier: " + name.replace(" ", "-")
        for plain, marked in MARKS:
            s = s.replace(plain, marked)
        texts.append(f"Words before.\n\n * {s}.\n\nWords after.")
    assert [r.sentence_ids for r in scanned(*texts)] == list(licenses.KNOWN.values())


def test_what_either_reading_knows_counts_at_its_place(scanned):
    notices = "Released under the MIT License\nLicensed under CC BY 4.0\nwords without an end"
    wrapped = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:\n"
    rows = scanned(f"{notices}\n\n{wrapped}\n{MIT}", f"{MIT}\n{notices}", "The MIT\nLicense\n\nThe\nMIT License")
    assert [r.sentence_ids for r in rows] == [
        "MitNotice,CcByNotice,BsdGrant,MitGrant,MitNotices", "MitGrant,MitNotices,MitNotice,CcByNotice", "MitTitle,MitTitle",
    ]
    assert [r.licenses for r in rows] == ["CC-BY-4.0,MIT", "CC-BY-4.0,MIT", "MIT"]
