"""Licences in texts, by their sentences. DataFrame functions only.

A text is normalised (lower case, runs of other characters than a-z and 0-9 become one space) with
its breaks marked: line ends, sentence ends, colons. A known licence sentence is found where it begins
and ends at a break, be it wrapped over lines in between, but not over a blank line. The identifiers that
are found, in order, are then matched against licence rules, the most specific first: a rule that
matches a run of consecutive identifiers claims it, and a later rule can't use it again. Both tables
are constants of this module and go into the plan as literals. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licence texts and of the notices that name them.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-copy-url": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "licensed under the mit license",
    "mit-released": "released under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "software-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "bsd-notice": "licensed under the bsd license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice": "licensed under the gnu general public license version 3",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-grant": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "gpl-details": "see the gnu general public license for more details",
    "agpl-details": "see the gnu affero general public license for more details",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "ofl-notice": "this font software is licensed under the sil open font license version 1 1",
    "boost-notice": "distributed under the boost software license version 1 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "this work is dedicated to the public domain under cc0 1 0",
    "rights-reserved": "all rights reserved",
}

#: Licence, and the sentence identifiers that have to follow one another; the first that matches wins.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-copy-url", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-url", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "software-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "software-as-is", "mit-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-released",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("Unlicense", ("unlicense-free",)),
    ("AGPL-3.0-or-later", ("agpl-grant", "gpl-hope", "agpl-details", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl-grant",)),
    ("LGPL-2.1-or-later", ("lgpl-grant", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-grant",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-hope", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-grant",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("LGPL-3.0", ("lgpl-notice",)),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")),
    ("MPL-2.0", ("mpl-notice",)),
    ("EPL-2.0", ("epl-notice",)),
    ("OFL-1.1", ("ofl-notice",)),
    ("BSL-1.0", ("boost-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("proprietary", ("rights-reserved",)),
)

#: A blank line ends a sentence; a line end, or space after one of these marks, may end it or lie inside.
BLANK, BREAK = r"\n[\x20\t\x0B\f\r]*\n", r"\n|(?<=[.!?:])\s"
#: Every known sentence holds one of these parts of words; a text without them has no known sentence.
HINTS = ("licen", "copyright", "software", "redistribut", "apache", "warrant", "domain", "reserved", "permission", "mozilla")
#: Sentences that aren't sought over a line's end before this word: their halves are known as well.
HALVES = {"apache-copy-url": "http"}


def pattern() -> str:
    """Any known sentence between two breaks, the longest first; "|" inside it is a break."""
    found = []
    for name, sentence in sorted(SENTENCES.items(), key=lambda x: -len(x[1])):
        words = sentence.split()
        found.append(words[0] + "".join(f" {w}" if w == HALVES.get(name) else rf"(?: \|)? {w}" for w in words[1:]))
    return f"(?<=[|=] )(?:{'|'.join(found)})(?= [|=])"


def normalised(text: Column) -> Column:
    """Words of a text, one space between them, breaks as "|" and blank lines as "="."""
    out = F.regexp_replace(F.lower(text), "[|=]", " ")
    for sought, put in ((BLANK, " = "), (BREAK, " | "), ("[^a-z0-9|=]+", " ")):
        out = F.regexp_replace(out, sought, put)
    out = F.concat(F.lit("= "), out, F.lit(" ="))
    for sought, put in ((r"[| ]*=[|= ]*", " = "), (r"[| ]*\|[| ]*", " | ")):
        out = F.regexp_replace(out, sought, put)
    return out


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    found = F.regexp_extract_all(normalised(text), F.lit(pattern()), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.replace(s, F.lit(" |"), F.lit(""))))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): doc_id, n_sentences (known ones), sentences (their
    identifiers in order, comma-joined), licences (each that a rule finds once, in the rules' order,
    comma-joined), n_unclaimed (known sentences that no rule claims).

    Null and empty texts have none. Repeated rows are scanned each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    hinted = F.contains(lower, F.lit(HINTS[0]))
    for hint in HINTS[1:]:
        hinted = hinted | F.contains(lower, F.lit(hint))
    found = docs.select("doc_id", F.when(hinted, sentence_ids(text)).otherwise(F.array().cast("array<string>")).alias("ids"))
    left = F.concat(F.lit("|"), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit("|"))), "|"))
    out = found.select("doc_id", "ids", left.alias("left_0"))
    for i, (_, ids) in enumerate(RULES):
        run = "|" + "||".join(ids) + "|"
        out = out.withColumn(f"hit_{i}", F.contains(F.col("left_0"), F.lit(run)))
        out = out.withColumn("left_0", F.replace(F.col("left_0"), F.lit(run), F.lit("#")))
    hits = F.array(*[F.when(F.col(f"hit_{i}"), F.lit(name)) for i, (name, _) in enumerate(RULES)])
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentences"),
        F.array_join(F.array_distinct(F.array_compact(hits)), ",").alias("licences"),
        F.regexp_count("left_0", F.lit("[a-z0-9]+[a-z0-9-]*")).cast("long").alias("n_unclaimed"),
    )
