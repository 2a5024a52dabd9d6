"""Licence recognition by sentence rules.

A text is normalised (lower case, letters and digits kept, one blank between words) with marks
where a sentence may end: line breaks, blank lines and marks of punctuation. Known licence
sentences that stand between two marks, over single line breaks too, become identifiers.
Identifiers in text order form a sequence; ordered rules, each a run of identifiers, are matched
against it. A rule uses up what it matches, so a longer licence isn't also named as a shorter one that it
contains; all licences of a text are told, and the first rule's stands alone too.

The knowledge tables are parameters of fixed size and become one map literal, so the plan is a
projection: no join, no shuffle. Null and empty texts have no sentences and no licence.
Repeated sentences repeat in the sequence, and repeated rows repeat; of several sentences that start at one place the longest holds.
Extra columns are left out, whatever their names. A very long text is read once by each expression and has as many identifiers as it has
known sentences. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences by which public licences are recognised, normalised as below.
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-short": "released under the mit license",
    "mit-named": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync-short": "licensed under cc by nc 4 0",
    "ccby-short": "licensed under cc by 4 0",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-head": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl2-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "epl2-head": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl2-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at",
    "epl1-head": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",
    "cc0-waiver": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    "cc0-title": "cc0 1 0 universal",
    "ccbysa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "ccbync-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "ccby-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "ccbysa-short": "licensed under cc by sa 4 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-title": "boost software license version 1 0",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache-title": "apache license version 2 0 january 2004",
}
# Licence rules in order; the first whose identifiers follow one another in the text holds.
RULES = [
    ("Apache-2.0", ["apache-head", "apache-comply"]),
    ("Apache-2.0", ["apache-comply", "apache-copy"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-named", "mit-grant"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-program", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-2.1-or-later", ["lgpl2-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-program"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]),
    ("CC-BY-SA-4.0", ["ccbysa-short"]),
    ("CC-BY-4.0", ["ccby-short"]),
    ("CC-BY-NC-4.0", ["ccbync-work"]),
    ("CC-BY-SA-4.0", ["ccbysa-work"]),
    ("CC-BY-4.0", ["ccby-work"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("MPL-2.0", ["mpl2-head"]),
    ("EPL-2.0", ["epl2-head"]),
    ("EPL-2.0", ["epl2-v"]),
    ("EPL-1.0", ["epl1-head"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("Unlicense", ["unlicense-anyone"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-title"]),
    ("Apache-2.0", ["apache-head"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-title"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("AGPL-3.0", ["agpl3-title"]),
]
# Further sentences that name a licence by themselves.
SENTENCES |= {
    "gpl2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "ccby-the-work": "this work is licensed under the creative commons attribution 4 0 international license",
    "ccbysa-the-work": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "ccbync-the-work": "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
}
RULES += [
    ("GPL-2.0-only", ["gpl2-only", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("CC-BY-4.0", ["ccby-the-work"]),
    ("CC-BY-SA-4.0", ["ccbysa-the-work"]),
    ("CC-BY-NC-4.0", ["ccbync-the-work"]),
]
# How notices of one line begin, and what they call a licence.
NOTICES = ("licensed under the", "released under the", "distributed under the", "available under the", "this project is licensed under the", "this software is licensed under the", "this library is licensed under the", "this code is licensed under the", "this project is released under the", "this software is released under the", "licensed under the terms of the", "distributed under the terms of the")
CALLED = {
    "MIT": ("mit license", "mit licence"), "Apache-2.0": ("apache license 2 0", "apache 2 0 license", "apache license version 2 0"), "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"), "ISC": ("isc license",), "MPL-2.0": ("mozilla public license 2 0", "mozilla public license version 2 0"), "Unlicense": ("unlicense",),
    "GPL-3.0": ("gnu general public license v3 0", "gnu general public license version 3"), "GPL-2.0": ("gnu general public license v2 0", "gnu general public license version 2"), "BSL-1.0": ("boost software license 1 0",), "Zlib": ("zlib license",),
}
for _name, _names in CALLED.items():
    for _k, _notice in enumerate(f"{x} {y}" for x in NOTICES for y in _names):
        if _notice not in SENTENCES.values():
            SENTENCES[f"notice-{_name}-{_k}"] = _notice
            RULES.append((_name, [f"notice-{_name}-{_k}"]))
# An identifier line of a source file names its licence by itself; so do expressions of two of the most common ones.
SPDX_ONLY = ("GPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "BSD-4-Clause", "Artistic-2.0", "OFL-1.1", "EUPL-1.2", "PostgreSQL", "WTFPL", "CC-BY-NC-SA-4.0")
SPDX_JOINED = ("MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "CC0-1.0")
SPDX_EXCEPTIONS = {"GPL-2.0-only": "Linux-syscall-note", "GPL-2.0-or-later": "Classpath-exception-2.0", "GPL-3.0-or-later": "GCC-exception-3.1", "Apache-2.0": "LLVM-exception"}
_expressions = [*dict.fromkeys([name for name, _ in RULES] + list(SPDX_ONLY))]
_expressions += [f"{x} {op} {y}" for op in ("OR", "AND") for x in SPDX_JOINED for y in SPDX_JOINED if x != y] + [f"{x} WITH {y}" for x, y in SPDX_EXCEPTIONS.items()]
for _name in _expressions:
    SENTENCES[f"spdx-{_name.replace(' ', '-')}"] = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())
    RULES.append((_name, [f"spdx-{_name.replace(' ', '-')}"]))
#: Words that a star in a known sentence may stand for, at most.
FREE_WORDS = 12
# A text becomes lower-case words with one separator between neighbours: a blank inside a line, SOFT where a sentence may end, HARD where one must.
SOFT, HARD = "\x02", "\x01"
#: What lies between two words, looked at once from its start: a blank line, also one of comment marks only; a line break; a mark that ends a sentence, a clause or an abbreviation.
_START, _LINE = "(?=[^a-z0-9])(?<![^a-z0-9])[^a-z0-9\n]*+\n", "[^a-z0-9\n]*+"
BREAKS = [(f"{_START}{_LINE}\n[^a-z0-9]*+", HARD), (f"{_START}{_LINE}", SOFT), (r"(?=[^a-z0-9])(?<![^a-z0-9])[^a-z0-9\n]*[.!?;:][ \t][^a-z0-9\n]*+", SOFT)]
NOT_WORD = f"[^a-z0-9{SOFT}{HARD}]+"


def marked_words(text: Column) -> Column:
    """Lower-case words of a text with blanks, SOFT and HARD between them, HARD at both ends."""
    out = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"\r\n?|[{SOFT}{HARD}]", "\n"))
    out = F.concat(F.lit("\n\n"), out, F.lit("\n\n"))
    for pattern, mark in BREAKS:
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(out, NOT_WORD, " ")


def _one_of(sentences: Sequence[str]) -> list[str]:
    """Words of which each sentence holds one at least: a text without any of them needs no regular expression."""
    out, rest = [], list(sentences)
    while rest:
        words = {w for s in rest for w in s.split()}
        best = max(sorted(words), key=lambda w: (sum(w in s for s in rest if len(w) > 4), len(w)))
        out.append(best)
        rest = [s for s in rest if best not in s]
    return out


def known_sentences(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in its order.

    A known sentence starts after a mark and ends before one, and may go on over SOFT marks inside:
    wrapped lines, comment prefixes and abbreviations don't hide it, and a notice on a line of its
    own needs no full stop. Where several start at one place, the longest holds.
    """
    exact = F.create_map(*(F.lit(x) for name, s in sentences.items() if "*" not in s for x in (s, name)))
    longest = sorted(sentences.values(), key=lambda s: (-len(s), s))
    known = "|".join(sentence_pattern(s, f"[ {SOFT}]") for s in longest)
    found = F.regexp_extract_all(marked_words(text), F.lit(f"(?<=[{SOFT}{HARD}])(?:{known})(?=[{SOFT}{HARD}])"), F.lit(0))
    lower = F.lower(F.coalesce(text, F.lit("")))
    may = F.exists(F.array(*map(F.lit, _one_of(longest))), lower.contains)

    def name(s):
        plain = F.translate(s, SOFT, " ")
        starred = [F.when(plain.rlike(f"^{sentence_pattern(s, ' ')}$"), name) for name, s in sentences.items() if "*" in s]
        return F.coalesce(F.try_element_at(exact, plain), *starred)

    return F.transform(F.when(may, found).otherwise(F.array().cast("array<string>")), name)


def sentence_pattern(sentence: str, blank: str) -> str:
    """Regular expression of a known sentence; a star stands for one to FREE_WORDS words."""
    return sentence.replace(" ", blank).replace(f"*{blank}", f"(?:[a-z0-9]+{blank}){{1,{FREE_WORDS}}}")


def matched_rules(sequence: Column, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> Column:
    """Numbers of the rules, from 1 and in order, whose identifiers stand next to each other among those that no earlier rule has used."""
    run = lambda ids: "".join(f"|{x}|" for x in ids)
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(run(ids)).alias("ids")) for k, (_, ids) in enumerate(rules, 1)))
    start = F.struct(F.concat(F.lit("|"), F.array_join(sequence, "||"), F.lit("|")).alias("rest"), F.array().cast("array<int>").alias("found"))

    def use(a, rule):
        used = F.struct(F.replace(a["rest"], rule["ids"], F.lit("-")).alias("rest"), F.array_append(a["found"], rule["k"]).alias("found"))
        return F.when(F.contains(a["rest"], rule["ids"]), used).otherwise(a)

    none = F.array().cast("array<int>")
    return F.when(F.size(sequence) > 0, F.aggregate(table, start, use, lambda a: a["found"])).otherwise(none) if rules else none


def scan_licenses(df: DataFrame, key: str, text: str, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """(key, n_sentences, sentence_ids, rule, license, licenses): one row for each row of df; rule and license are the first rule's."""
    names = F.array(*(F.lit(name) for name, _ in rules)).cast("array<string>")
    out = df.select(F.col(key).alias("key"), known_sentences(F.col(text), sentences).alias("found")).withColumn("rules", matched_rules(F.col("found"), rules))
    first = F.try_element_at("rules", F.lit(1))
    name = lambda k: F.try_element_at(names, k)
    all_ = F.array_join(F.array_distinct(F.transform("rules", name)), "|")
    return out.select(F.col("key").alias(key), F.size("found").cast("long").alias("n_sentences"), F.array_join("found", "|").alias("sentence_ids"), first.alias("rule"), name(first).alias("license"), all_.alias("licenses"))
