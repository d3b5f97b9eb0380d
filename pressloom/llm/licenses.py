"""License scan by sentence rules (native): known sentences become identifiers, identifier sequences become licenses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import table, text_of
from pressloom.llm.syncmers import let

#: Normalised sentences (lower case, every run of other characters than letters and digits one space) and their
#: identifiers. The wording of public license texts and notices.
SENTENCES = {
    "released under the mit license": "MitNotice",
    "licensed under the mit license": "MitNotice",
    "this project is licensed under the mit license": "MitNotice",
    "spdx license identifier mit": "MitNotice",
    "mit license": "MitTitle",
    "the mit license": "MitTitle",
    "the mit license mit": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the software": "MitNotices",
    "licensed under the apache license version 2 0": "ApacheNotice",
    "licensed under the apache license version 2 0 the license": "ApacheNotice",
    "spdx license identifier apache 2 0": "ApacheNotice",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "this work is licensed under the gnu general public license version 2": "Gpl2Notice",
    "spdx license identifier gpl 2 0 only": "Gpl2Notice",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "spdx license identifier gpl 3 0 only": "Gpl3Notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 2 of the license or at your option any later "
    "version": "Gpl2Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later "
    "version": "Gpl3Later",
    "see the gnu general public license for more details": "GplDetails",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by 4 0": "CcByNotice",
    "licensed under cc by sa 4 0": "CcBySaNotice",
    "licensed under cc by nc 4 0": "CcByNcNotice",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcByNotice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNcNotice",
    "all rights reserved": "AllRights",
}
#: Ordered rules: the identifiers of a license one after another, and its name. An earlier rule takes its identifiers
#: away from the later ones. Fixed values.
RULES = [
    (("MitTitle", "MitGrant", "MitNotices"), "MIT"),
    (("MitGrant", "MitNotices"), "MIT"),
    (("MitGrant",), "MIT"),
    (("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"), "BSD-3-Clause"),
    (("BsdGrant", "BsdSource", "BsdBinary"), "BSD-2-Clause"),
    (("ApacheNotice", "ApacheComply", "ApacheCopy"), "Apache-2.0"),
    (("Gpl2Later", "GplDetails", "GplReceived"), "GPL-2.0-or-later"),
    (("Gpl3Later", "GplDetails", "GplReceived"), "GPL-3.0-or-later"),
    (("Gpl2Later",), "GPL-2.0-or-later"),
    (("Gpl3Later",), "GPL-3.0-or-later"),
    (("ApacheNotice",), "Apache-2.0"),
    (("Gpl2Notice",), "GPL-2.0-only"),
    (("Gpl3Notice",), "GPL-3.0-only"),
    (("MitNotice",), "MIT"),
    (("MitTitle",), "MIT"),
    (("CcByNcNotice",), "CC-BY-NC-4.0"),
    (("CcBySaNotice",), "CC-BY-SA-4.0"),
    (("CcByNotice",), "CC-BY-4.0"),
]

#: Names of the GNU licenses in their notices, the identifiers' stem, and the versions with their SPDX names.
_GNU = [
    ("gnu general public license", "Gpl", {"2": "GPL-2.0", "2 0": "GPL-2.0", "3": "GPL-3.0", "3 0": "GPL-3.0"}),
    ("gnu lesser general public license", "Lgpl", {"2 1": "LGPL-2.1", "3": "LGPL-3.0", "3 0": "LGPL-3.0"}),
    ("gnu library general public license", "Lgpl", {"2": "LGPL-2.0", "2 0": "LGPL-2.0"}),
    ("gnu affero general public license", "Agpl", {"3": "AGPL-3.0", "3 0": "AGPL-3.0"}),
]
_WORKS = ("program", "library", "file", "software")
#: SPDX names for which a tag, "licensed under ..." and "released under ..." are known besides those of SENTENCES.
_NAMES = {
    "MIT": "MitNotice", "Apache-2.0": "ApacheNotice", "BSD-2-Clause": "Bsd2Notice", "BSD-3-Clause": "Bsd3Notice", "MPL-2.0": "MplNotice",
    "ISC": "IscNotice", "Unlicense": "UnlicenseNotice", "CC0-1.0": "Cc0Notice", "CC-BY-4.0": "CcByNotice", "CC-BY-SA-4.0": "CcBySaNotice",
    "CC-BY-NC-4.0": "CcByNcNotice", "Zlib": "ZlibNotice", "BSL-1.0": "BoostNotice", "EPL-2.0": "Epl2Notice", "EPL-1.0": "Epl1Notice",
    "0BSD": "ZeroBsdNotice", "WTFPL": "WtfplNotice", "Artistic-2.0": "ArtisticNotice", "PostgreSQL": "PostgresNotice", "MIT-0": "Mit0Notice",
    "CDDL-1.0": "CddlNotice", "EUPL-1.2": "EuplNotice", "OFL-1.1": "OflNotice", "Python-2.0": "PythonNotice", "NCSA": "NcsaNotice",
    "MPL-1.1": "Mpl1Notice", "CC-BY-3.0": "CcBy3Notice", "CC-BY-SA-3.0": "CcBySa3Notice", "CC-BY-ND-4.0": "CcByNdNotice",
}


def _plain(words: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in words.lower()).split())


def _more() -> tuple[dict[str, str], list[tuple[tuple[str, ...], str]]]:
    """Sentences and rules besides SENTENCES and RULES, for the splitting that :func:`whole_sentences` protects."""
    known = {
        "this source code form is subject to the terms of the mozilla public license v 2 0": "MplNotice",
        "mozilla public license version 2 0": "MplTitle",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MplCopy",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MplCopy",
        "isc license": "IscTitle",
        "the isc license": "IscTitle",
        "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseAnyone",
        "cc0 1 0 universal": "Cc0Title",
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this "
        "software to the public domain worldwide": "Cc0Grant",
        "you should have received a copy of the cc0 public domain dedication along with this software": "Cc0Received",
        "licensed under the mozilla public license version 2 0": "MplNotice",
        "licensed under the isc license": "IscNotice",
        "licensed under the boost software license version 1 0": "BoostNotice",
        "distributed under the boost software license version 1 0": "BoostNotice",
        "the names of its contributors may not be used to endorse or promote products derived from this software without specific "
        "prior written permission": "BsdEndorse",
        "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
        "you may obtain a copy of the license at https www apache org licenses license 2 0": "ApacheCopy",
    }
    for use in ("and or distribute", "and distribute"):
        known[
            f"permission to use copy modify {use} this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies"
        ] = "IscGrant"
    rules = [
        (("MplNotice", "MplCopy"), "MPL-2.0"), (("IscTitle", "IscGrant"), "ISC"), (("IscGrant",), "ISC"), (("UnlicenseGrant", "UnlicenseAnyone"), "Unlicense"),
        (("UnlicenseGrant",), "Unlicense"), (("Cc0Grant", "Cc0Received"), "CC0-1.0"), (("Cc0Grant",), "CC0-1.0"), (("MplTitle",), "MPL-2.0"),
        (("IscTitle",), "ISC"), (("Cc0Title",), "CC0-1.0"),
    ]
    for spdx, name in _NAMES.items():
        known[f"spdx license identifier {_plain(spdx)}"] = name
        for verb in ("licensed", "released"):
            known.setdefault(f"{verb} under {_plain(spdx)}", name)
        rules.append(((name,), spdx))
    for license, stem, versions in _GNU:
        details, received = f"{stem}Details", f"{stem}Received"
        known[f"see the {license} for more details"] = details
        for work in _WORKS:
            known[f"you should have received a copy of the {license} along with this {work}"] = received
        for version, spdx in versions.items():
            digit = spdx.split("-")[1].replace(".", "").removesuffix("0")
            later, only, notice, later_notice = (f"{stem}{digit}{x}" for x in ("Later", "Only", "Notice", "LaterNotice"))
            for work in _WORKS:
                start = f"this {work} is free software you can redistribute it and or modify it under the terms of the {license}"
                free = "as published by the free software foundation"
                known[f"{start} {free} either version {version} of the license or at your option any later version"] = later
                for form in (f"{free} version {version} of the license", f"{free} version {version}", f"version {version} {free}", f"version {version}"):
                    known[f"{start} {form}"] = only
            for text in ("this work is licensed", "licensed", "released"):
                known[f"{text} under the {license} version {version}"] = notice
                known[f"{text} under the {license} version {version} or later"] = later_notice
            for text in (spdx, f"{spdx}-only"):
                known[f"spdx license identifier {_plain(text)}"] = notice
            known[f"spdx license identifier {_plain(spdx)} or later"] = later_notice
            for name, suffix in ((later, "or-later"), (only, "only")):
                if ((name,), f"{spdx}-{suffix}") not in RULES:
                    rules += [((name, details, received), f"{spdx}-{suffix}"), ((name, details), f"{spdx}-{suffix}"), ((name,), f"{spdx}-{suffix}")]
            rules += [((later_notice,), f"{spdx}-or-later"), ((notice,), f"{spdx}-only")]
    return known, rules


_MORE_SENTENCES, _MORE_RULES = _more()
#: All that the operator knows. The SQL below has SENTENCES and RULES only.
KNOWN = {**_MORE_SENTENCES, **SENTENCES}
ALL_RULES = list(dict.fromkeys([*RULES, *_MORE_RULES]))

#: Where a sentence ends: always at closing marks before a blank; in the line reading at every line break too, in the
#: flowing reading at empty lines only, for texts wrapped inside sentences.
LINES = r"[.!?;:]*[\x20\t]*[\n\r]+|[.!?;:]+[\x20\t]+"
FLOW = r"[.!?;:]*[\x20\t]*[\n\r][\x20\t]*[\n\r]+|[.!?;:]+[\x20\t\n\r]+"


#: Marks inside known sentences at which nothing ends: 'free software: you', 'Foundation; either version 2', 'v. 2.0'.
INSIDE = r"(?<=\bsoftware)[:;](?=[^\p{L}\p{N}]{1,40}you )|(?<=\bfoundation)[:;](?=[^\p{L}\p{N}]{1,40}(?:either )?version )|(?<=\bv)\.(?=[\x20\t]+[0-9])"
_TAG = "spdx-license-identifier:"
#: Operators between the names of an SPDX expression, and an exception with its name.
BETWEEN = rf"[\x20\t(]+(?:or|and)[\x20\t(]+(?<={_TAG}[^\n\r]{{1,400}})"
EXCEPT = rf"[\x20\t)]+with[\x20\t]+(?<={_TAG}[^\n\r]{{1,400}})"
#: What stands between two words of a sentence: blanks, line breaks, the marks of comment lines.
_GAP = r"[^\p{L}\p{N}\x01]{1,40}"
#: The clause of BSD-3-Clause, whoever is named in it, and the name that SENTENCES has in this place.
HOLDER = _GAP.join(["neither", "the", "names?", "of"]) + rf"{_GAP}[^\x01]{{1,300}}?{_GAP}" + _GAP.join(
    ["nor", "the", "names", "of", "(?:its|their|the|any)", "contributors", "may", "be", "used"]
)
HELD = "neither the name of the copyright holder nor the names of its contributors may be used"
_SPELT = "|".join(sorted((n.lower().replace("-", "[- ]").replace(".", r"\.") for n in _NAMES), key=len, reverse=True))
#: Notices that name what is licensed, and by which verb, as 'licensed under' and the SPDX name.
NOTICE = (
    r"\b(?:th(?:is|e)[\x20\t]+(?:file|project|software|program|library|package|code|source code|module|script|repository)[\x20\t]+is[\x20\t]+)?"
    r"(?:licensed|released|distributed|available)[\x20\t]+under[\x20\t]+(?:the[\x20\t]+terms[\x20\t]+of[\x20\t]+)?(?:the[\x20\t]+)?"
    rf"({_SPELT})(?:[\x20\t]+licen[cs]e)?(?=[\x20\t]*(?:[.!?;:]*[\x20\t\n\r]|[.!?;:]*$))"
)
#: The same as a field: 'license: MIT' on a line of its own.
FIELD = rf"(?m)(?<=^[^\p{{L}}\p{{N}}\n\r]{{0,10}})licen[cs]e:[\x20\t]*[\"']?({_SPELT})[\"']?(?=[^\p{{L}}\p{{N}}\n\r]{{0,10}}$)"


def open_places(low: Column) -> Column:
    """Lower-case text in which sentences with a name in them have the name that the known sentence has."""
    low = F.when(F.contains(low, F.lit("neither")), F.regexp_replace(low, HOLDER, HELD)).otherwise(low)
    low = F.when(F.contains(low, F.lit(" under ")), F.regexp_replace(low, NOTICE, "licensed under $1")).otherwise(low)
    return F.when(low.rlike("licen[cs]e:"), F.regexp_replace(low, FIELD, "licensed under $1")).otherwise(low)


def whole_sentences(text: Column) -> Column:
    """Lower-case text in which known sentences hold together, and each name of an SPDX tag is a sentence with the tag."""
    low = F.lower(text)
    tags = F.regexp_replace(low, rf"(?<={_TAG}[^\n\r]{{1,400}})(?<=[a-z0-9])\+", "-or-later")
    tags = F.regexp_replace(F.regexp_replace(tags, EXCEPT, "\u0001"), BETWEEN, f"\u0001{_TAG} ")
    tags = F.regexp_replace(tags, rf"{_TAG}[\x20\t]*", "\u0001spdx license identifier ")
    low = let(F.when(F.contains(low, F.lit(_TAG)), tags).otherwise(low), open_places)
    return F.regexp_replace(low, INSIDE, " ")


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of both readings in order of place; unknown ones are passed over.

    Every end of the flowing reading is an end of the line reading too, so a flowing sentence is a run of whole lines:
    if it is known it stands for them (the longest first), if not, those of its lines that are known count.
    """
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    cut = F.regexp_replace(whole_sentences(text), FLOW, "\u0001")
    pieces = F.split(F.regexp_replace(cut, r"[^\p{L}\p{N}\x01\n\r]+", " "), "\u0001", -1)

    def of_lines(piece: Column) -> Column:
        known = F.filter(F.transform(F.split(piece, r"[\n\r]+", -1), lambda s: F.trim(s)), lambda s: s.isin(*KNOWN))
        return F.transform(known, lambda s: F.element_at(names, s))

    def of_piece(piece: Column) -> Column:
        def named(whole: Column) -> Column:
            lines = F.when(piece.rlike(r"[\n\r]"), of_lines(piece)).otherwise(F.array().cast("array<string>"))
            return F.when(whole.isin(*KNOWN), F.array(F.element_at(names, whole))).otherwise(lines)

        return let(F.trim(F.regexp_replace(piece, r"[\x20\n\r]+", " ")), named)

    return F.flatten(F.transform(pieces, of_piece))


def ruled(left: Column) -> Column:
    """(left, found): the rules one after another on identifiers written as " A  B ".

    With two blanks between, neighbouring matches of one rule never share a blank.
    """
    rules = F.array(*[
        F.struct(F.lit(" " + "  ".join(sequence) + " ").alias("wanted"), F.lit(f" #{number} ").alias("mark"), F.lit(name).alias("name"))
        for number, (sequence, name) in enumerate(ALL_RULES)
    ])
    return F.aggregate(
        rules,
        F.struct(left.alias("left"), F.array().cast("array<string>").alias("found")),
        lambda acc, r: F.struct(
            F.replace(acc["left"], r["wanted"], r["mark"]).alias("left"),
            F.when(F.contains(acc["left"], r["wanted"]), F.array_append(acc["found"], r["name"])).otherwise(acc["found"]).alias("found"),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, sentence_ids, licenses, n_known, n_unmatched``.

    What either reading of the text recognises counts, at its place; within a known flowing sentence its lines do not.
    ``sentence_ids``: the identifiers, comma-joined in order. ``licenses``: names of the rules that match, sorted,
    each once, comma-joined. ``n_unmatched``: known sentences that no rule takes. Everything happens inside the row,
    so there is no shuffle and no hot key.

    Null and empty texts have no sentences (empty strings, zeros). Repeated rows are scanned each, texts of any length whole.
    Other columns are not read, an empty table gives an empty one.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), identifiers(text).alias("ids"))
    left = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    rows = rows.withColumn("ruled", F.when(F.size("ids") > 0, ruled(left)).otherwise(F.struct(F.lit(" ").alias("left"), F.lit(None).alias("found"))))
    rows = rows.select("doc_id", "ids", F.col("ruled.left").alias("left"), F.coalesce("ruled.found", F.array().cast("array<string>")).alias("found"))
    unmatched = F.filter(F.split(F.trim("left"), " +"), lambda s: (s != "") & ~s.startswith("#"))
    return rows.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"),
        F.size("ids").cast("long").alias("n_known"), F.size(unmatched).cast("long").alias("n_unmatched"),
    )


def op3_licenses(spark, sf_dir):
    """All ``documents``."""
    return scan(table(spark, sf_dir))


def _oracle() -> str:
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    cut = "list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{}', chr(1), 'g'), '[^\\p{{L}}\\p{{N}}\\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s))"
    left, found = "' ' || array_to_string(ids, '  ') || ' '", []
    steps, last = [], "base"
    for number, (sequence, name) in enumerate(RULES):
        wanted = " " + "  ".join(sequence) + " "
        steps.append(
            f"r{number} AS (SELECT doc_id, ids, CASE WHEN contains(l, '{wanted}') THEN list_append(f, '{name}') ELSE f END AS f, "
            f"replace(l, '{wanted}', ' #{number} ') AS l FROM {last})"
        )
        last = f"r{number}"
    return rf"""
WITH known AS (SELECT map_from_entries(list((s, i))) AS m, list(s) AS k FROM (VALUES {values}) v(s, i)),
both_ways AS (
  SELECT doc_id, list_transform(list_filter({cut.format(LINES)}, lambda s: list_contains(k, s)), lambda s: m[s]) AS a,
    list_transform(list_filter({cut.format(FLOW)}, lambda s: list_contains(k, s)), lambda s: m[s]) AS b FROM documents, known),
chosen AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids FROM both_ways),
base AS (SELECT doc_id, ids, CAST([] AS VARCHAR[]) AS f, {left} AS l FROM chosen),
{', '.join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_sort(list_distinct(f)), ',') AS licenses,
  len(ids) AS n_known, len(list_filter(string_split(trim(l), ' '), lambda s: s <> '' AND NOT starts_with(s, '#'))) AS n_unmatched FROM {last}
"""


ORACLE = _oracle()
