"""Licence scan by sentences and ordered rules.

1. A normalised text is its lower-case letters and digits, in words joined by
   one space: line breaks, comment marks and punctuation vanish.
2. Sentences that the table knows are found in it by position, wherever they
   stand, and become identifiers; all other words are dropped. Where several
   begin at one word the longest counts, and none begins inside another. The
   table is one expression with a branch for each next word, so its size hardly
   matters to a text's time.
3. A rule is a sequence of identifiers. It matches a document whose identifiers
   contain it in order, whatever stands between. A licence whose rule is part of
   the rule of another licence that matches too is not reported.

Everything is an expression on the row: nothing is exploded or shuffled, and a
document of any length is scanned whole.

Cases: a null or empty text has no licence; null ids stay; repeated rows get
the same result each; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licences, by identifier.
SENTENCES = {
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache.notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at",
    "gpl3.notice": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd.named": "may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "gpl2.notice": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2.only": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21.notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3.notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3.notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense.domain": "This is free and unencumbered software released into the public domain.",
    "boost.grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib.origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "wtfpl.copy": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "mpl11.notice": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "epl1.notice": "made available under the terms of the Eclipse Public License v1.0",
    "epl2.notice": "made available under the terms of the Eclipse Public License 2.0",
    "cddl.notice": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "mpl2.notice": "is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Ordered rules, by licence identifier.
RULES = [
    ("MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("ISC", ["isc.grant", "isc.warranty"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.named"]),
    ("BSD-4-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.names"]),
    ("Apache-2.0", ["apache.notice", "apache.comply"]),
    ("GPL-2.0-only", ["gpl2.only"]),
    ("GPL-2.0-or-later", ["gpl2.notice"]),
    ("GPL-3.0-or-later", ["gpl3.notice"]),
    ("LGPL-2.1-or-later", ["lgpl21.notice"]),
    ("LGPL-3.0-or-later", ["lgpl3.notice"]),
    ("AGPL-3.0-or-later", ["agpl3.notice"]),
    ("MPL-1.1", ["mpl11.notice"]),
    ("MPL-2.0", ["mpl2.notice"]),
    ("EPL-1.0", ["epl1.notice"]),
    ("EPL-2.0", ["epl2.notice"]),
    ("CDDL-1.0", ["cddl.notice"]),
    ("Unlicense", ["unlicense.domain"]),
    ("BSL-1.0", ["boost.grant"]),
    ("Zlib", ["zlib.grant", "zlib.origin"]),
    ("WTFPL", ["wtfpl.copy"]),
]

# Names by which texts call a licence, by licence identifier.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License v3.0", "Academic Free License version 3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3", "GNU AGPLv3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "AGPLv3+"],
    "APSL-2.0": ["Apple Public Source License 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache Software License, Version 2.0"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-clause BSD license", "Original BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "CC-BY-2.0": ["CC BY 2.0", "Creative Commons Attribution 2.0 Generic License"],
    "CC-BY-2.5": ["CC BY 2.5", "Creative Commons Attribution 2.5 Generic License"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0 License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"],
    "CC-BY-NC-3.0": ["CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 3.0 Unported License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-3.0": ["CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0 License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 License"],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License 1.1", "CDDL 1.1"],
    "CECILL-2.1": ["CeCILL License v2.1", "CeCILL 2.1"],
    "CPL-1.0": ["Common Public License 1.0", "Common Public License Version 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"],
    "EUPL-1.1": ["European Union Public Licence 1.1", "EUPL 1.1", "EUPL, Version 1.1"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2", "EUPL, Version 1.2"],
    "GFDL-1.3-only": ["GNU Free Documentation License, Version 1.3", "GFDL 1.3"],
    "GFDL-1.3-or-later": ["GNU Free Documentation License, Version 1.3 or any later version"],
    "GPL-1.0-only": ["GNU General Public License, version 1", "GPLv1"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GNU GPLv2", "GPL v2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later", "GPLv2 or later", "GPLv2+"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPL v3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later", "GPLv3 or later", "GPLv3+"],
    "ISC": ["ISC License", "ISC Licence"],
    "LGPL-2.0-only": ["GNU Library General Public License, version 2", "GNU Library General Public License v2.0"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL v2.1", "LGPLv2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later", "LGPLv2.1 or later", "LGPLv2.1+"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL v3", "LGPLv3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later", "LGPLv3 or later", "LGPLv3+"],
    "LPPL-1.3c": ["LaTeX Project Public License 1.3c", "LaTeX Project Public License, Version 1.3c"],
    "MIT": ["MIT License", "MIT Licence", "MIT", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License"],
    "MPL-1.0": ["Mozilla Public License 1.0", "Mozilla Public License, Version 1.0", "MPL 1.0"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPLv2"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan PSL v2", "Mulan Permissive Software License, Version 2"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License v1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"],
    "OSL-3.0": ["Open Software License 3.0", "Open Software License v3.0"],
    "PHP-3.01": ["PHP License, version 3.01", "PHP License 3.01"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "PSF License"],
    "PostgreSQL": ["PostgreSQL License", "PostgreSQL Licence"],
    "Ruby": ["Ruby License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "UPL-1.0": ["Universal Permissive License v1.0", "Universal Permissive License, Version 1.0"],
    "Vim": ["Vim License"],
    "W3C": ["W3C Software Notice and License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "ZPL-2.1": ["Zope Public License, Version 2.1", "Zope Public License 2.1"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}

# What stands before the name of a licence in a notice.
NOTICES = ["licensed under", "released under", "distributed under", "available under", "under the terms of", "subject to the terms of"]
SPDX = "SPDX-License-Identifier:"


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES, names: dict[str, list[str]] = NAMES) -> dict[str, str]:
    """Normalised sentence to identifier: those of the table, and every notice and tag that names a licence."""
    known = {}
    for licence, called in names.items():
        known[normalise(f"{SPDX} {licence}")] = f"{licence}.tag"
        for name in called:
            for notice in NOTICES:
                for article in ("", "the ", "a "):
                    known[normalise(f"{notice} {article}{name}")] = f"{licence}.name"
    return known | {normalise(text): name for name, text in sentences.items()}


def all_rules(rules: list = RULES, names: dict[str, list[str]] = NAMES) -> list[tuple[str, list[str]]]:
    """The rules, and one for each identifier that names a licence."""
    return [*rules, *((licence, [f"{licence}.{kind}"]) for licence in names for kind in ("name", "tag"))]


def sentence_pattern(known) -> str:
    """A regular expression of all sentences: a tree by words, the longest sentence first."""
    tree: dict = {}
    for sentence in known:
        node = tree
        for word in sentence.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def branch(node: dict) -> str:
        parts = []
        for word, below in node.items():
            if not word:
                continue
            chain = [word]
            while len(below) == 1 and "" not in below:
                ((word, below),) = below.items()
                chain.append(word)
            rest = {w: b for w, b in below.items() if w}
            tail = f"(?: {branch(rest)})" + "?" * ("" in below) if rest else ""
            parts.append(" ".join(chain) + r"\b" + tail)
        return "(?:" + "|".join(parts) + ")"

    return r"\b" + branch(tree)


def covers(long: list[str], short: list[str]) -> bool:
    """Whether ``long`` has more identifiers than ``short`` and holds them in order."""
    left = iter(long)
    return len(long) > len(short) and all(name in left for name in short)


def _map(pairs) -> Column:
    """A constant map, as one literal."""
    return F.str_to_map(F.lit("\n".join(f"{key}\t{value}" for key, value in dict(pairs).items())), F.lit("\n"), F.lit("\t"))


def _identifiers(text: Column, known: dict[str, str]) -> Column:
    table = _map(known.items())
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.transform(F.regexp_extract_all(plain, F.lit(sentence_pattern(known)), F.lit(0)), lambda s: F.element_at(table, s))


def _rule(names: list[str]) -> str:
    return ".*".join(f"<{re.escape(n)}>" for n in names)


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, names: dict[str, list[str]] = NAMES,
) -> DataFrame:
    """Id, ``sentences`` (identifiers in order) and ``licences`` (sorted, distinct) of every row."""
    found = docs.select(F.col(id_col).alias("id"), _identifiers(F.col(text_col), known_sentences(sentences, names)).alias("sentences"))
    every = all_rules(rules, names)
    single = _map((first, licence) for licence, (first, *more) in every if not more)
    code = F.concat(F.lit("<"), F.array_join("sentences", "><"), F.lit(">"))
    matches = lambda own: F.col("code").rlike(_rule(own))
    hits = []
    for licence, own in every:
        if len(own) > 1:
            hit = matches(own)
            for other, wider in every:
                if other != licence and covers(wider, own):
                    hit = hit & ~matches(wider)
            hits.append(F.when(hit, F.lit(licence)))
    one = F.array_compact(F.transform("sentences", lambda s: F.try_element_at(single, s)))
    all_ = F.when(F.size("sentences") > 0, F.concat(one, F.array_compact(F.array(*hits)))).otherwise(F.array().cast("array<string>"))
    return found.withColumn("code", code).select(F.col("id").alias(id_col), "sentences", F.array_sort(F.array_distinct(all_)).alias("licences"))
