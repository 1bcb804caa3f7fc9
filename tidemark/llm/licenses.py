"""Licence recognition by sentence rules, in DataFrame functions alone.

SENTENCES and RULES are the short forms, which the SQL beside the query has as well; FULL_SENTENCES and FULL_RULES are the
licences' true wording, which may be wrapped over several lines.

Normalised sentences that are known licence sentences become identifiers; a document's sequence of identifiers is
then searched for the ordered rules.  Both tables are small and fixed, and are part of the expression: nothing
is joined, shuffled or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Normalised sentences of well-known licences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-obtain",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-free",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "licensed under cc by nc 4 0": "cc-by-nc-4-ref",
    "licensed under cc by 4 0": "cc-by-4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-4-ref",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "all rights reserved": "reserved",
}
# Each licence and a sequence of identifiers that shows it; identifiers of a rule follow one another.
RULES = [
    ("Apache-2.0", ["apache2-ref"]),
    ("Apache-2.0", ["apache2-comply", "apache2-obtain"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"]),
    ("CC-BY-4.0", ["cc-by-4-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-ref"]),
    ("GPL", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Proprietary", ["reserved"]),
]
_FSF = "under the terms of the gnu {} public license as published by the free software foundation {}"
_LATER = "of the license or at your option any later version"
_HOPE = "this {} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_ISC = "permission to use copy modify and{} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
#: The clause of BSD-3-Clause names an organisation; any name is read as the copyright holder.
NAMED = "^neither the name of .{1,200}? (nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission)$"
_free = lambda what, kind, version: f"this {what} is free software you can redistribute it and or modify it " + _FSF.format(
    kind, version,
)
# Whole normalised sentences of the licences' own texts and file headers.
FULL_SENTENCES = {
    next(s for s, i in SENTENCES.items() if i == "mit-grant") + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    _AS_IS: "as-is",
    "licensed under the mit license": "mit-ref",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-ref",
    _BINARY: "bsd-binary",
    _BINARY.replace("redistributions in binary", "and redistributions in binary"): "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    **{
        f"this work is licensed under a creative commons attribution{kind} 4 0 international license": f"cc-by{short}-4-ref"
        for kind, short in (("", ""), (" sharealike", "-sa"), (" noncommercial", "-nc"))
    },
    _ISC.format(""): "isc-grant",
    _ISC.format(" or"): "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-ref",  # the sentence ends at "v."
    **{_free(what, "general", f"{e}version {v} {_LATER}"): f"gpl{v}-free" for what in ("program", "file") for v in "23" for e in ("", "either ")},
    **{_free("program", "general", f"version {v} of the license"): f"gpl{v}-free" for v in "23"},
    **{_free(what, "lesser general", f"either version {v} {_LATER}"): f"lgpl{v.replace(' ', '')}-free" for what in ("library", "program") for v in ("2 1", "3")},
    **{_free("program", "affero general", f"either version 3 {_LATER}"): "agpl3-free"},
    **{_HOPE.format(what): "gpl-hope" for what in ("program", "library")},
}
FULL_RULES = [
    ("AGPL-3.0", ["agpl3-free"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-name"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("GPL-3.0", ["gpl3-free"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("LGPL-3.0", ["lgpl3-free"]),
    ("MPL-2.0", ["mpl2-ref"]),
]
#: Each known sentence has one of these words, so a text without any has none of them; single words stay as they are when a sentence is normalised.
TRIGGERS = "licen|permission|copyright|software|reserved|warranty"


def recognise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sequence, licenses) for each row of ``docs`` (doc_id, text), without a shuffle.

    n_sentences: how many known sentences the whole text has; sequence: their identifiers in order, comma-joined;
    licenses: the licences whose rule matches, each once, in alphabetical order, comma-joined.  A sentence ends at a line without letters and digits or
    at ``.``, ``!`` or ``?`` before white space.  Its lines are looked up one by one, and, where none is known, as one sentence, so that
    wrapped text is found; letters are compared in lower case, all but a-z and 0-9 as blanks.
    The two clauses of BSD-3-Clause are not BSD-2-Clause as well.
    Null and empty texts have no sentences; repeated rows stay; no rows give none.  Other columns are ignored.
    """
    known = F.create_map(*(F.lit(x) for pair in {**SENTENCES, **FULL_SENTENCES}.items() for x in pair))
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    full = lambda s: F.regexp_replace(plain(s), NAMED, "neither the name of the copyright holder $1")
    among = lambda parts: F.filter(F.transform(parts, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    whole = F.split("text", r"(?<=[.!?])[ \t\r\n]+|\n[^A-Za-z0-9\n]*\n")
    by_line = lambda s: among(F.transform(F.split(s, "\n"), plain))
    ids = F.flatten(F.transform(whole, lambda s: F.when(F.size(by_line(s)) > 0, by_line(s)).otherwise(among(F.array(full(s))))))
    found = F.when(F.lower("text").rlike(TRIGGERS), ids).otherwise(F.array().cast("array<string>"))
    seq = docs.select("doc_id", F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    seq = seq.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sequence"))
    framed = F.concat(F.lit(","), F.col("sequence"), F.lit(","))
    three = "," + ",".join(next(rule for name, rule in FULL_RULES if name == "BSD-3-Clause")) + ","
    two = F.replace(framed, F.lit(three), F.lit(",,"))
    hits = F.array_compact(F.array(*(F.when((two if name == "BSD-2-Clause" else framed).contains("," + ",".join(rule) + ","), F.lit(name)) for name, rule in RULES + FULL_RULES)))
    return seq.withColumn(
        "licenses", F.when(F.col("n_sentences") > 0, F.array_join(F.array_sort(F.array_distinct(hits)), ",")).otherwise(""),
    )
