"""Licence scan by sentence rules.

A text is cut into sentences; each sentence, each line in it and each clause are normalised and looked up among known licence
sentences. A clause is a paragraph of wrapped lines, or what stands before or behind a colon that ends a line or introduces a
list; list numbers are no part of it. The identifiers found, in order, form the document's sequence; ordered rules, longer
ones first, are matched against it and use up what they match. Sentences that are more than ``MAX_GAP`` apart do not belong to one rule.

Only DataFrame functions are used: the known sentences are a small fixed table, so the lookup needs no shuffle, and only
recognised sentences are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossloom.llm.common import text_or_empty

MAX_GAP = 2

#: Known sentences, normalised: lower case, letters, digits and + only, single spaces.
SENTENCES = {
    "apache-line": ["licensed under the apache license version 2 0", "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0"],
    "apache-grant": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license version 2 0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-line": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "the mit license", "mit license", "the mit license mit"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is-software": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-line": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2-line": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    "lgpl3-line": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl3-line": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "bsd-line": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "bsd2-line": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-line": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "ccbync-line": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbysa-line": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccby-line": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0-line": ["dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"],
    "rights-reserved": ["all rights reserved"],
    "spdx-apache": ["spdx license identifier apache 2 0"],
    "spdx-mit": ["spdx license identifier mit"],
    "spdx-gpl3": ["spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "spdx-bsd": ["spdx license identifier bsd 3 clause"],
}

#: Ordered rules: (licence, sentence identifiers). The first that matches uses up its sentences.
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-basis", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see", "gpl-received"]),
    ("MIT", ["mit-line", "mit-grant", "mit-notice", "as-is-software"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("Apache-2.0", ["apache-grant", "apache-comply"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-line"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["spdx-mit"]),
    ("GPL-3.0-only", ["gpl3-line"]),
    ("GPL-3.0-only", ["spdx-gpl3"]),
    ("GPL-2.0-only", ["gpl2-line"]),
    ("LGPL-3.0-only", ["lgpl3-line"]),
    ("AGPL-3.0-only", ["agpl3-line"]),
    ("BSD-3-Clause", ["bsd-line"]),
    ("BSD-3-Clause", ["spdx-bsd"]),
    ("BSD-2-Clause", ["bsd2-line"]),
    ("MPL-2.0", ["mpl2-line"]),
    ("CC-BY-NC-4.0", ["ccbync-line"]),
    ("CC-BY-SA-4.0", ["ccbysa-line"]),
    ("CC-BY-4.0", ["ccby-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("Proprietary", ["rights-reserved"]),
]

#: Further titles, headers, heads of whole texts and families, and rules for whole licence texts with a title or a line of
#: rights. They come before ``RULES``; the comparison SQL, which cuts sentences and lines only, does not have them.
MORE_SENTENCES = {
    "bsd-line": ["bsd 3 clause license", "the bsd 3 clause license", "3 clause bsd license", "the 3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "the new bsd license", "modified bsd license", "revised bsd license"],
    "bsd2-line": ["bsd 2 clause license", "the bsd 2 clause license", "2 clause bsd license", "the 2 clause bsd license", "bsd 2 clause simplified license", "simplified bsd license", "the simplified bsd license", "freebsd license", "released under the bsd 2 clause license"],
    "bsd-name": ["nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache-line": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses", "distributed under the apache license version 2 0", "this project is licensed under the apache license 2 0", "licensed under the apache license 2 0", "apache license 2 0"],
    "mit-line": ["this project is licensed under the mit license", "distributed under the mit license", "expat license", "the mit license expat"],
    "gpl3-line": ["gnu general public license version 3 29 june 2007", "licensed under the gnu general public license v3 0", "this program is licensed under the gnu general public license version 3"],
    "gpl2-line": ["gnu general public license version 2 june 1991", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0", "licensed under the gnu general public license v2 0"],
    "gpl2-later-line": ["spdx license identifier gpl 2 0 or later", "spdx license identifier gpl 2 0+"],
    "lgpl3-line": ["gnu lesser general public license version 3 29 june 2007", "spdx license identifier lgpl 3 0 only"],
    "lgpl21-line": ["gnu lesser general public license version 2 1 february 1999", "licensed under the gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1"],
    "agpl3-line": ["gnu affero general public license version 3 19 november 2007", "spdx license identifier agpl 3 0 only"],
    "mpl2-line": ["mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "mpl2-grant": ["this source code form is subject to the terms of the mozilla public license v"],
    "bsd2-spdx": ["spdx license identifier bsd 2 clause"],
    "gpl-modify": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl-modify": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-modify": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "either-2": ["either version 2 of the license or at your option any later version"],
    "either-2-1": ["either version 2 1 of the license or at your option any later version"],
    "either-3": ["either version 3 of the license or at your option any later version"],
    "only-2": ["version 2 of the license", "version 2"],
    "lgpl21-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl3-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-line": ["isc license", "the isc license", "licensed under the isc license", "released under the isc license", "spdx license identifier isc"],
    "0bsd-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier 0bsd"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "spdx license identifier zlib"],
    "boost-line": ["boost software license version 1 0 17 august 2003", "boost software license version 1 0 august 17th 2003", "distributed under the boost software license version 1 0", "spdx license identifier bsl 1 0"],
    "eclipse-line": ["eclipse public license v 2 0", "eclipse public license version 2 0", "spdx license identifier epl 2 0"],
    "cc0-line": ["cc0 1 0 universal", "spdx license identifier cc0 1 0"],
    "ccby-line": ["spdx license identifier cc by 4 0"],
}
#: Sentences that name two licences: each stands for both identifiers, in this order.
EITHER_OF = {
    ("apache-line", "mit-line"): ["apache license version 2 0 or mit license", "licensed under either of apache license version 2 0 or mit license at your option", "licensed under the apache license version 2 0 or mit license", "licensed under the apache license version 2 0 or the mit license", "dual licensed under the apache license version 2 0 and the mit license", "spdx license identifier apache 2 0 or mit", "spdx license identifier mit or apache 2 0", "licensed under the mit license or the apache license version 2 0"],
}
#: Names in a sentence that may be any: they are put back to the wording of the table.
_GAPS = [
    (r"^neither the names? of .{1,160}? nor the names of (?:its|their|any|the) contributors may be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from (?:this|the) software without (?:specific )?prior written permission(?: of .{1,120})?$", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (r"^.{1,80}? is free software you can redistribute it and or modify it under the terms of", "this program is free software you can redistribute it and or modify it under the terms of"),
    (r"^you may obtain a copy of the license at https www", "you may obtain a copy of the license at http www"),
]
#: A line of rights before one of these is part of its notice.
_GRANTS = ["apache-grant", "gpl-free", "gpl2-free", "gpl-modify", "lgpl-modify", "agpl-modify", "lgpl21-free", "lgpl3-free", "agpl3-free", "mpl2-grant", "isc-grant", "0bsd-grant", "zlib-grant"]
MORE_RULES = [
    ("GPL-2.0-or-later", ["gpl-modify", "either-2"]),
    ("GPL-3.0-or-later", ["gpl-modify", "either-3"]),
    ("GPL-2.0-only", ["gpl-modify", "only-2"]),
    ("LGPL-2.1-or-later", ["lgpl-modify", "either-2-1"]),
    ("LGPL-3.0-or-later", ["lgpl-modify", "either-3"]),
    ("AGPL-3.0-or-later", ["agpl-modify", "either-3"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("LGPL-2.1-only", ["lgpl21-line"]),
    ("GPL-2.0-or-later", ["gpl2-later-line"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("BSD-2-Clause", ["bsd2-spdx"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-line"]),
    ("0BSD", ["0bsd-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-line"]),
    ("EPL-2.0", ["eclipse-line"]),
]
_TEXTS = [
    ("BSD-3-Clause", "bsd-line", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-3-Clause", "bsd-line", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", "bsd2-line", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", "mit-line", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT", "mit-line", ["mit-grant", "mit-notice"]),
]
TEXT_RULES = [(name, [title, "rights-reserved", *text]) for name, title, text in _TEXTS]
TEXT_RULES += [(name, [title, *text]) for name, title, text in _TEXTS if name != "MIT"]
TEXT_RULES += [(name, ["rights-reserved", *text]) for k, (name, _, text) in enumerate(_TEXTS) if k != 1]  # without its title, that text is BSD-2
ALL_RULES = TEXT_RULES + MORE_RULES + RULES

#: Behind these a clause ends: a colon at the end of a line, lines without letters or digits, a line before a list number.
_NUMBER = r"\(?(?:[0-9]{1,2}|[A-Za-z])[.)]"
_CLAUSE_END = rf"(:[ \t\r\"'*#/-]{{0,8}}\n|\n[^A-Za-z0-9]*\n|\n(?=[ \t*#/-]{{0,16}}{_NUMBER}[ \t]))"
#: Where a clause is cut once more: between a colon or a line end and a list number.
_LIST = rf"(?::[ \t]{{1,8}}|\n[ \t*#/-]{{0,16}})(?={_NUMBER}(?:\s|$))"
_LEADING = rf"^[^A-Za-z0-9(]{{0,16}}{_NUMBER}\s"


def _pattern(sentences: list[str]) -> str:
    return "".join(f"<{s}>" for s in sentences)


def recognised(docs: DataFrame) -> DataFrame:
    """The known sentences of every row of docs (doc_id, text): row, doc_id, sentence, line, sentence_id."""
    known = [(text, 0, name) for table in (SENTENCES, MORE_SENTENCES) for name, texts in table.items() for text in texts]
    known += [(text, k, name) for names, texts in EITHER_OF.items() for text in texts for k, name in enumerate(names)]
    known = docs.sparkSession.createDataFrame(sorted(set(known)), "normal string, nth int, sentence_id string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ended = F.regexp_replace("text", r"([.!?;])[ \t\n\r]+", "$1\u0001")
    sentences = rows.select("row", "doc_id", F.posexplode(F.split(ended, "\u0001")).alias("sentence", "body"))
    clauses = F.split(F.regexp_replace("body", _CLAUSE_END, "$1\u0002"), "\u0002")
    parts = F.flatten(F.transform(clauses, lambda c: F.concat(F.array(c), F.split(c, "\n"), F.transform(F.split(c, _LIST), lambda x: F.regexp_replace(x, _LEADING, "")))))
    forms = F.concat(F.array("body"), F.when(F.col("body").rlike("[\n:]"), F.array_distinct(parts)).otherwise(F.array()))
    def plain(form):
        out = F.trim(F.regexp_replace(F.lower(form), "[^a-z0-9+]+", " "))
        for pattern, wording in _GAPS:
            out = F.regexp_replace(out, pattern, wording)
        return out

    normal = F.transform(forms, plain)
    lines = sentences.select("row", "doc_id", "sentence", F.posexplode(F.array_distinct(normal)).alias("line", "normal"))
    return lines.join(F.broadcast(known), "normal").drop("normal")  # a fixed table of this module


def licences(docs: DataFrame) -> DataFrame:
    """Licences of the rows of docs in which one is found: doc_id, licences, n_matches, n_sentences, sequence.

    ``licences`` lists each licence once, in the order of the rules; ``sequence`` the identifiers, with ``|`` at a gap. Rows
    without a match, null and empty texts among them, have no result row; null and repeated doc_ids stay apart, as a row is
    named by its place; other columns are ignored.
    """
    found = F.array_sort(F.collect_list(F.struct("sentence", "line", "nth", "sentence_id")))
    rows = recognised(docs).groupBy("row", "doc_id").agg(found.alias("found"))

    def sign(x, k):
        gap = (k > 0) & (x["sentence"] - F.get(F.col("found"), k - 1)["sentence"] > MAX_GAP + 1)
        return F.concat(F.when(gap, "|").otherwise(""), F.lit("<"), x["sentence_id"], F.lit(">"))

    rows = rows.select("doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join(F.transform("found", sign), "").alias("sequence"))
    rest, counts = F.regexp_replace("sequence", f"<rights-reserved>(?=<({'|'.join(_GRANTS)})>)", ""), []
    for k, (_, sentences) in enumerate(ALL_RULES):
        pattern = _pattern(sentences)
        rows = rows.withColumns({f"_n{k}": ((F.length(rest) - F.length(F.replace(rest, F.lit(pattern), F.lit("")))) / len(pattern)).cast("long"), "_rest": F.replace(rest, F.lit(pattern), F.lit("."))})
        rest = F.col("_rest")
        counts.append(F.col(f"_n{k}"))
    names = F.array_distinct(F.array_compact(F.array(*(F.when(n > 0, F.lit(name)) for n, (name, _) in zip(counts, ALL_RULES)))))
    rows = rows.select("doc_id", F.array_join(names, ",").alias("licences"), sum(counts[1:], counts[0]).alias("n_matches"), "n_sentences", "sequence")
    return rows.where("n_matches > 0")


def licences_sql() -> str:
    """The same result in DuckDB's SQL, for texts whose clauses are sentences or single lines."""
    known = ", ".join(f"('{text}', '{name}')" for name, texts in SENTENCES.items() for text in texts)
    steps, names, before = [], [], "seqs"
    for k, (name, sentences) in enumerate(RULES):
        pattern = _pattern(sentences)
        rest = "sequence" if k == 0 else "rest"
        kept = "*" if k == 0 else "* exclude (rest)"
        steps.append(f"r{k} as (select {kept}, (length({rest}) - length(replace({rest}, '{pattern}', ''))) // {len(pattern)} as n{k}, replace({rest}, '{pattern}', '.') as rest from {before})")
        names.append(name)
        before = f"r{k}"
    first = {name: [k for k, n in enumerate(names) if n == name] for name in dict.fromkeys(names)}
    listed = ", ".join(f"case when {' + '.join(f'n{k}' for k in ks)} > 0 then '{name}' end" for name, ks in first.items())
    order = ", ".join(f"least({', '.join(f'case when n{k} > 0 then {k} else 999 end' for k in ks)}, 999)" for ks in first.values())
    total = " + ".join(f"n{k}" for k in range(len(RULES)))
    return f"""
    with known(normal, sentence_id) as (values {known}),
    numbered as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    sentences as (select row, doc_id, unnest(parts) as body, generate_subscripts(parts, 1) as sentence
      from (select row, doc_id, string_split(regexp_replace(text, '([.!?;])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)) as parts from numbered)),
    lines as (select row, doc_id, sentence, 0 as line, body as form from sentences
      union all select row, doc_id, sentence, unnest(generate_series(1, len(parts))), unnest(parts)
      from (select row, doc_id, sentence, string_split(body, chr(10)) as parts from sentences where contains(body, chr(10)))),
    found as (select row, doc_id, sentence, min(line) as line, sentence_id from
      (select *, trim(regexp_replace(lower(form), '[^a-z0-9+]+', ' ', 'g')) as normal from lines) join known using (normal)
      group by row, doc_id, sentence, normal, sentence_id),
    gaps as (select *, lag(sentence) over (partition by row order by sentence, line) as prev from found),
    seqs as (select row, doc_id, count(*) as n_sentences,
      string_agg(case when sentence - prev > {MAX_GAP + 1} then '|' else '' end || '<' || sentence_id || '>', '' order by sentence, line) as sequence
      from gaps group by row, doc_id),
    {', '.join(steps)},
    named as (select *, {total} as n_matches, list_zip([{order}], [{listed}]) as pairs from {before})
    select doc_id, array_to_string(list_transform(list_sort(list_filter(pairs, lambda p: p[2] is not null)), lambda p: p[2]), ',') as licences,
      n_matches, n_sentences, sequence from named where n_matches > 0
    """
