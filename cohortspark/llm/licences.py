"""Licence scans by sentence rules.

A text is normalised (lower case, runs of other characters than letters and digits become one blank; line ends and
the ends of sentences and paragraphs stay) and searched for known licence sentences. A sentence is known where it
equals one or more whole lines or the rest of a line after a sentence's end, however it is wrapped and with whatever
comment leaders. The identifiers found, in text order, are matched against ordered rules: a licence is recognised where
all identifiers of one of its rules follow one another, with others between them where the rule has a gap. DataFrame functions only; every row is handled by itself,
nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, by identifier.
SENTENCES = {
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-title": "gnu general public license",
    "gpl3-version": "version 3 29 june 2007",
    "arr": "all rights reserved",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "mit-notice": "released under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-file": "you may not use this file except in compliance with the license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "public-domain": "this is free and unencumbered software released into the public domain",
}
#: Licence and the sentences that must follow one another.
RULES = [
    ("AllRightsReserved", ("arr",)),
    ("Apache-2.0", ("apache-notice",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0", ("gpl3-title", "gpl3-version")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant", "mit-condition")),
    ("Unlicense", ("public-domain",)),
]
#: Sentences of the usual file headers and the title lines of Apache-2.0, and their rules: searched for besides those above.
HEADERS = {
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache-site": "http www apache org licenses license 2 0",
    "apache-site-tls": "https www apache org licenses license 2 0",
    "apache-title": "apache license",
    "apache-version": "version 2 0 january 2004",
}
HEADER_RULES = [
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-asf",)),
    ("Apache-2.0", ("apache-file", "apache-site")),
    ("Apache-2.0", ("apache-file", "apache-site-tls")),
    ("Apache-2.0", ("apache-title", "apache-version")),
]
#: Sentences of further licences' texts, titles and notices, normalised, by identifier.
TEXTS = {
    "apache-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "gpl1-version": "version 1 february 1989",
    "gpl2-version": "version 2 june 1991",
    "lgpl-title": "gnu lesser general public license",
    "lgpl-library-title": "gnu library general public license",
    "lgpl21-version": "version 2 1 february 1999",
    "agpl-title": "gnu affero general public license",
    "agpl3-version": "version 3 19 november 2007",
    "mpl2-title": "mozilla public license version 2 0",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl11-notice": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "epl1-title": "eclipse public license v 1 0",
    "epl2-title": "eclipse public license v 2 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-notice": "distributed under the boost software license version 1 0",
    "artistic2-title": "the artistic license 2 0",
    "cddl-title": "common development and distribution license cddl version 1 0",
    "python-title": "python software foundation license version 2",
    "eupl-title": "european union public licence v 1 2",
    "ncsa-title": "university of illinois ncsa open source license",
    "ofl-title": "sil open font license version 1 1 26 february 2007",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "odbl-title": "open database license odbl v1 0",
    "sspl-title": "server side public license",
    "sspl-version": "version 1 october 16 2018",
    "cc0-title": "cc0 1 0 universal",
}
#: Between two sentences of a rule: any others.
GAP = "..."
TEXT_RULES = [
    ("0BSD", ("0bsd-grant",)),
    ("AGPL-3.0", ("agpl-title", "agpl3-version")),
    ("Apache-2.0", ("apache-grant",)),
    ("Artistic-2.0", ("artistic2-title",)),
    ("BSD-2-Clause", ("bsd-grant", GAP, "bsd-source", GAP, "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", GAP, "bsd-source", GAP, "bsd-binary", GAP, "bsd-endorse")),
    ("BSD-4-Clause", ("bsd-grant", GAP, "bsd-source", GAP, "bsd-binary", GAP, "bsd-advertise", GAP, "bsd-endorse")),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-notice",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CDDL-1.0", ("cddl-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("EUPL-1.2", ("eupl-title",)),
    ("GPL-1.0", ("gpl3-title", "gpl1-version")),
    ("GPL-2.0", ("gpl3-title", "gpl2-version")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("LGPL-2.0", ("lgpl-library-title", "gpl2-version")),
    ("LGPL-2.1", ("lgpl-title", "lgpl21-version")),
    ("LGPL-3.0", ("lgpl-title", "gpl3-version")),
    ("MIT", ("mit-grant", GAP, "mit-condition")),
    ("MIT-0", ("mit0-grant",)),
    ("MPL-1.1", ("mpl11-notice",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("NCSA", ("ncsa-title",)),
    ("ODbL-1.0", ("odbl-title",)),
    ("OFL-1.1", ("ofl-title",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("Python-2.0", ("python-title",)),
    ("SSPL-1.0", ("sspl-title", "sspl-version")),
    ("Zlib", ("zlib-warranty", GAP, "zlib-grant")),
]
#: A licence whose sentences are all part of another's is not reported beside it.
PART_OF = {"BSD-2-Clause": ("BSD-3-Clause", "BSD-4-Clause"), "BSD-3-Clause": ("BSD-4-Clause",)}


#: Any words on the same line, up to so many: before or after a notice, or where a licence names an organisation.
BEFORE, AFTER, SOMEONE = "<8>", "<12>", "<-12>"
#: Known sentences with a part that may be any words.
OPEN = {
    "bsd-endorse-org": f"neither the name of {SOMEONE} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-orgs": f"neither the names of {SOMEONE} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-name": f"the name of {SOMEONE} may not be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Names that prose gives licences, and the licence: "licensed under the ... license".
PROSE = {
    "mit license": "MIT",
    "mit licence": "MIT",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "mozilla public license 2 0": "MPL-2.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "gnu general public license v2 0": "GPL-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license v3 0": "GPL-3.0",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "gplv2": "GPL-2.0",
    "gplv3": "GPL-3.0",
    "unlicense": "Unlicense",
}


def _notices() -> tuple[dict[str, str], dict[str, str], list]:
    """Notices in prose, the GNU licences of one version only, and tags of a licence identifier."""
    known, free, rules = {}, {}, []
    for name, licence in PROSE.items():
        for verb in ("licensed", "released", "distributed", "available"):
            key = f"prose-{verb}-{name.replace(' ', '-')}"
            free[key] = f"{BEFORE} {verb} under the {name} {AFTER}"
            rules.append((licence, (key,)))
    for short, name, versions in (("GPL", "general", ("2", "3")), ("LGPL", "lesser general", ("2.1", "3")), ("AGPL", "affero general", ("3",))):
        for v in versions:
            number = v.replace(".", " ")
            for n, terms in enumerate((f"gnu {name} public license version {number}", f"version {number} of the gnu {name} public license")):
                key = f"{short.lower()}-{v}-only-{n}"
                known[key] = f"you can redistribute it and or modify it under the terms of {'the ' if not n else ''}{terms} as published by the free software foundation"
                rules.append((f"{short}-{v if '.' in v else v + '.0'}-only", (key,)))
    names = {licence for licence, _ in RULES + HEADER_RULES + TEXT_RULES + rules + _families()[1]} - {"AllRightsReserved"}
    for licence in sorted(names):
        known[f"spdx-{licence.lower()}"] = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", licence.lower())
        rules.append((licence, (f"spdx-{licence.lower()}",)))
    rules += [(name, tuple(open_ if i == "bsd-endorse" else i for i in ids)) for name, ids in TEXT_RULES if "bsd-endorse" in ids for open_ in OPEN]
    return known, OPEN | free, rules


def _families() -> tuple[dict[str, str], list]:
    """File notices of the GNU licences with a later version, and titles of the Creative Commons licences, by their patterns."""
    known, rules = {}, []
    for short, name, versions in (("gpl", "general", ("2", "3")), ("lgpl", "lesser general", ("2.1", "3")), ("agpl", "affero general", ("3",))):
        known[f"{short}-terms"] = f"you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation"
        for v in versions:
            known[f"later-{v}"] = f"either version {v.replace('.', ' ')} of the license or at your option any later version"
            known[f"{short}-{v}-later"] = known[f"{short}-terms"] + " " + known[f"later-{v}"]
            spdx = f"{short.upper()}-{v if '.' in v else v + '.0'}-or-later"
            rules += [(spdx, (f"{short}-{v}-later",)), (spdx, (f"{short}-terms", f"later-{v}"))]
    for short, name in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")):
        for tail in ("", " public license"):
            known[f"cc-{short}-title{tail.replace(' ', '-')}"] = f"creative commons {name} 4 0 international{tail}"
            rules.append((f"CC-{short.upper()}-4.0", (f"cc-{short}-title{tail.replace(' ', '-')}",)))
    return known, rules


FAMILIES, FAMILY_RULES = _families()
NOTICES, FREE, NOTICE_RULES = _notices()
FREE_RULES = [rule for rule in NOTICE_RULES if any(i in FREE for i in rule[1])]
KNOWN, ALL_RULES = SENTENCES | HEADERS | TEXTS | FAMILIES | NOTICES, RULES + HEADER_RULES + TEXT_RULES + FAMILY_RULES + [r for r in NOTICE_RULES if r not in FREE_RULES]
#: Every known sentence has one of these beginnings of a word; texts without any can't hold one.
SIGNS = ("licen", "permission", "redistribut", "reserved", "unencumbered", "warranty", "version", "commons", "cc0", "advertising", "gplv")
TAG = "(?i)(SPDX-License-Identifier):"
ENDS = r"([.!?;:])[ \t\r\n\f\x0B]+"
#: What comes before a line's text: comment leaders, bullets, numbers of a list.
LEADER = r"(^|\n)[^\p{L}\p{N}\n]*(?:(?i:dnl|rem)[ \t]+)?(?:\(?(?i:[0-9]{1,2}|[a-z]|[ivx]{2,4})\)[ \t]+)?"
OTHER = r"[^a-z0-9\n]+"


def sentences(text: Column) -> Column:
    """Pieces between line ends and sentence ends; an identifier's tag does not end one."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "$1"), ENDS, "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: s != "")


def normalise(text: Column) -> Column:
    """Words with one blank between them; a line end within a paragraph is one newline, the end of a sentence or paragraph two."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "$1"), "\r\n?", "\n")
    marked = F.regexp_replace(F.regexp_replace(lines, LEADER, "$1"), ENDS, "$1\n\n")
    return F.regexp_replace(F.regexp_replace(F.lower(marked), OTHER, " "), " ?\n ?", "\n")


def pattern(ids: tuple[str, ...]) -> str:
    """A regular expression over ",id,id,": the identifiers follow one another, with others between them at a gap."""
    return "," + "".join("(?:[^,]+,)*" if i == GAP else re.escape(i).replace("\\-", "-") + "," for i in ids)


def _free(sentence: str, gap: str) -> str:
    """A regular expression for a known sentence with open parts; gap stands between words."""
    out = ""
    for w in sentence.split(" "):
        if w == BEFORE:
            out += f"(?:[a-z0-9]+ ){{0,{BEFORE[1:-1]}}}"
        elif w == AFTER:
            out = out.removesuffix(gap) + f"(?: [a-z0-9]+){{0,{AFTER[1:-1]}}}"
        elif w == SOMEONE:
            out += f"(?:[a-z0-9]+{gap}){{1,{SOMEONE[2:-1]}}}"
        else:
            out += w + gap
    return out.removesuffix(gap)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] = KNOWN, rules: list = ALL_RULES + FREE_RULES, part_of: dict[str, tuple] = PART_OF, free: dict[str, str] = FREE) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, n_licences): one row for each row of docs.

    n_sentences counts the pieces between line ends and sentence ends, sentence_ids are the identifiers found in text
    order, licences the recognised ones sorted, without those that are part of another recognised one, both comma-joined. A known sentence may span lines, not paragraphs; of
    two that begin at one place the longer is found, those with open parts (`free`) last. Null and empty texts have no sentences; a
    repeated row gives a repeated result; long texts are searched whole, in one pass. Texts without any of SIGNS can't hold a known
    sentence and are not searched."""
    table = F.create_map(*[F.lit(x) for name, s in known.items() for x in (s, name)])
    longest_first = sorted(known.values(), key=len, reverse=True)
    wrapped = "|".join(["[ \n]".join(map(re.escape, s.split(" "))) for s in longest_first] + [_free(s, "[ \n]") for s in free.values()])
    low = F.lower(F.coalesce(text, F.lit("")))
    signed = reduce(lambda a, b: a | b, [low.contains(x) for x in SIGNS])
    matches = F.regexp_extract_all(F.trim(normalise(F.col(text))), F.lit(rf"(?<![^\n])(?:{wrapped})(?![^\n])"), F.lit(0))
    opened = lambda m: reduce(lambda rest, x: F.when(F.rlike(m, F.lit(f"^{_free(x[1], ' ')}$")), x[0]).otherwise(rest), reversed(free.items()), F.lit(None).cast("string"))
    named = F.transform(matches, lambda m: F.coalesce(table[F.translate(m, "\n", " ")], opened(F.translate(m, "\n", " "))))
    found = docs.select(doc_id, F.size(sentences(F.col(text))).cast("long").alias("n_sentences"), F.when(signed, named).otherwise(F.array().cast("array<string>")).alias("_ids"))
    found = found.withColumn("_seq", F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(",")))
    matched = F.array_distinct(F.filter(F.array(*[F.when(F.rlike(F.col("_seq"), F.lit(pattern(ids))), F.lit(name)) for name, ids in rules]), lambda x: x.isNotNull()))
    found = found.withColumn("_m", matched)
    covered = lambda x: reduce(lambda a, b: a | b, [(x == part) & F.arrays_overlap("_m", F.array(*map(F.lit, wholes))) for part, wholes in part_of.items()], F.lit(False))
    whole = F.filter("_m", lambda x: ~covered(x))
    return found.withColumn("_l", F.array_sort(whole)).select(doc_id, "n_sentences", F.array_join("_ids", ",").alias("sentence_ids"), F.array_join("_l", ",").alias("licences"), F.size("_l").cast("long").alias("n_licences"))


def op5_licences(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def oracle() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{name}'" for name, s in KNOWN.items())
    opened = " ".join(f"WHEN regexp_matches(t, '^{_free(s, ' ')}$') THEN '{name}'" for name, s in FREE.items())
    rules = ", ".join(f"CASE WHEN regexp_matches(seq, '{pattern(ids)}') THEN '{name}' END" for name, ids in ALL_RULES + FREE_RULES)
    parts = " OR ".join(f"(x = '{p}' AND list_has_any(l, {list(w)}))" for p, w in PART_OF.items())
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{TAG}', '\1', 'g'), '([.!?;:])[ \t\r\n\f\x0B]+', '\1' || chr(10), 'g'), chr(10)), lambda s: s <> '') AS s FROM documents),
one AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS nth FROM cut),
plain AS (SELECT r, nth, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS t FROM one),
named AS (SELECT r, nth, coalesce(CASE t {cases} END, CASE {opened} END) AS name FROM plain),
ids AS (SELECT r, string_agg(name, ',' ORDER BY nth) AS ids FROM named WHERE name IS NOT NULL GROUP BY r),
joined AS (SELECT doc_id, len(s) AS n, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS seq FROM cut LEFT JOIN ids USING (r)),
every AS (SELECT doc_id, n, ids, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS l FROM joined),
matched AS (SELECT doc_id, n, ids, list_filter(l, lambda x: NOT ({parts})) AS l FROM every)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids, array_to_string(l, ',') AS licences, CAST(len(l) AS BIGINT) AS n_licences FROM matched"""
