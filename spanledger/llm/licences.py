"""Licences named in texts, by sentences and ordered rules over them.

A text is cut at line ends and stops, a piece goes on into the next ones up to a full
stop or a blank line (licence texts are wrapped), each is normalised, and those equal to or starting with
a known licence sentence get its identifier. The sequence of identifiers is then
matched with the rules in their order; a rule that finds its sentences next to each
other (other text may lie between) claims them, so a general rule only gets what the
special ones before it left.

The project keeps no licence records; messages and report texts are its only prose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.rows import texts

#: Identifier and regular expression of each known licence sentence, as
#: lower-case words separated by single blanks. A sentence matches from its start.
SENTENCES = [
    ("mit_short", "(this (work|software|file|code) is )?(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("apache_2", "(this (work|software|file) is )?licensed under the apache license,? version 2[.]0"),
    ("apache_use", "you may not use this file except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at"),
    ("apache_limits", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis"),
    ("agpl_3", "(this (work|program|software|file) is )?(licensed|released|distributed) under the (terms of the )?gnu affero general public license,? version 3"),
    ("lgpl_3", "(this (work|program|software|file|library) is )?(licensed|released|distributed) under the (terms of the )?gnu lesser general public license,? version 3"),
    ("lgpl_21", "(this (work|program|software|file|library) is )?(licensed|released|distributed) under the (terms of the )?gnu lesser general public license,? version 2[.]1"),
    ("mpl_2", "this source code form is subject to the terms of the mozilla public license,? v\\b"),
    ("epl_2", "this program and the accompanying materials are made available under the terms of the eclipse public license,? (v |version )?2[.]0"),
    ("boost_1", "(this (work|program|software|file) is )?(licensed|released|distributed) under the boost software license,? version 1[.]0"),
    ("isc_grant", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("gpl_3", "(this (work|program|software|file) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? version 3"),
    ("gpl_2", "(this (work|program|software|file) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license,? version 2"),
    ("gpl_any", "(this (work|program|software|file) is )?(licensed|released|distributed) under the (terms of the )?gnu general public license$"),
    ("gpl_free", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful, but without any warranty"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program"),
    ("cc_by_nc_4", "(this work is )?licensed under (cc by-nc 4[.]0|a creative commons attribution-noncommercial 4[.]0 international license)"),
    ("cc_by_sa_4", "(this work is )?licensed under (cc by-sa 4[.]0|a creative commons attribution-sharealike 4[.]0 international license)"),
    ("cc_by_4", "(this work is )?licensed under (cc by 4[.]0|a creative commons attribution 4[.]0 international license)"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as_is", "the software is provided as is, without warranty of any kind"),
    ("bsd_grant", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_name", "neither the name of .* nor the names of its contributors may be used to endorse or promote products"),
    ("public_domain", "this (work|software|file) is (in|released into|dedicated to) the public domain"),
    ("reserved", "all rights reserved"),
]

#: Licence and its sentences, special rules before general ones.
RULES = [
    ("Apache-2.0", ["apache_2", "apache_use", "apache_copy", "apache_limits"]),
    ("GPL-3.0-only", ["gpl_3", "gpl_hope", "gpl_copy"]),
    ("GPL", ["gpl_free", "gpl_hope", "gpl_copy"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("Apache-2.0", ["apache_2"]),
    ("AGPL-3.0-only", ["agpl_3"]),
    ("LGPL-3.0-only", ["lgpl_3"]),
    ("LGPL-2.1-only", ["lgpl_21"]),
    ("MPL-2.0", ["mpl_2"]),
    ("EPL-2.0", ["epl_2"]),
    ("BSL-1.0", ["boost_1"]),
    ("ISC", ["isc_grant"]),
    ("Unlicense", ["unlicense"]),
    ("GPL-3.0-only", ["gpl_3"]),
    ("GPL-2.0-only", ["gpl_2"]),
    ("GPL", ["gpl_any"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("MIT", ["mit_short"]),
    ("Public-Domain", ["public_domain"]),
    ("All-Rights-Reserved", ["reserved"]),
]

#: A sentence without one of these can match no known sentence.
KEYWORDS = "licen|copyright|redistribut|warrant|permission is hereby|public domain|rights reserved|endorse"

#: What begins a comment line; the first words of the known sentences; more words than any has.
COMMENT = "^\\s*(//+|/[*]+|--+)"
STARTS = "^(this|released|licensed|distributed|available|you|unless|permission|the|redistributions?|neither|all)\\b"
WORDS = 40
#: A text without one of these words has no known sentence, however it is wrapped.
ANYWHERE = "licen|copyright|redistribut|warrant|permission|public|reserved|endorse"


def licence_sentences(messages: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """id and sentences, the identifiers of the known sentences of each whole text in order."""
    docs = texts(messages, id_column, content)
    cut = F.regexp_replace(F.coalesce("content", F.lit("")), "([.!?;:]) +", "$1\n")
    lines = F.split(F.lower(cut), "\r?\n")
    plain = F.transform(
        lines,
        lambda s: F.btrim(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace(s, COMMENT, ""), "[^a-z0-9./,-]+", " "), "[ .,]+( |$)", " "
            ),
            F.lit(" "),
        ),
    )
    pieces = F.transform(
        F.arrays_zip(lines.alias("raw"), plain.alias("plain")),
        # A blank line or a full stop ends a sentence, so no sentence goes on behind it.
        lambda x: F.struct(
            x["plain"].alias("plain"),
            F.when((x["plain"] == "") | x["raw"].rlike("[.!?][^a-z0-9]*$"), "\n").otherwise(" ").alias("end"),
        ),
    )

    def known(s):
        out = F.lit(None).cast("string")
        for name, pattern in reversed(SENTENCES):
            out = F.when(s.rlike("^" + _without_stops(pattern)), name).otherwise(out)
        return out

    def at(x, k):
        near = F.slice("pieces", k + 1, WORDS)
        joined = F.array_join(F.transform(near, lambda y: F.concat(y["plain"], y["end"])), "")
        alone = F.when(x["plain"].rlike(KEYWORDS), known(x["plain"]))
        # gpl_any means the bare name, which only the end of a line shows.
        return F.when(x["plain"].rlike(STARTS), F.coalesce(alone, known(joined)))

    some = F.lower("content").rlike(ANYWHERE)
    docs = docs.select("id", F.when(some, pieces).otherwise(F.array().cast("array<struct<plain:string,end:string>>")).alias("pieces"))
    return docs.select("id", F.filter(F.transform("pieces", at), lambda x: x.isNotNull()).alias("sentences"))


def _without_stops(pattern: str) -> str:
    """The pattern for sentences whose commas before blanks were taken out."""
    return pattern.replace(",?", "").replace(",", "")


def _sequence(names: list[str]) -> str:
    return "".join(f"<{n}>" for n in names)


def licence_findings(messages: DataFrame, id_column: str = "id", content: str = "content") -> DataFrame:
    """id, sentences, licences (without repeats, in rule order) and unclaimed sentences.

    A rule claims its sentences wherever they follow each other and no rule before it
    has claimed one of them, however often. unclaimed holds the known sentences that no
    rule claimed, which hints at a licence text that is incomplete or changed. A null or
    empty text has none of them; a very long text is judged whole; a null id is passed
    on; repeated rows are judged each; no rows give no rows.
    """
    df = licence_sentences(messages, id_column, content)
    df = df.withColumn("left_", F.array_join(F.transform("sentences", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    df = df.withColumn("named", F.array().cast("array<string>"))
    for licence, names in RULES:
        wanted = F.lit(_sequence(names))
        df = df.withColumn("hit", F.contains("left_", wanted)).withColumn(
            "named", F.when(F.col("hit"), F.array_union("named", F.array(F.lit(licence)))).otherwise(F.col("named"))
        )
        # What was claimed leaves a mark, so that its neighbours do not become neighbours.
        df = df.withColumn("left_", F.when(F.col("hit"), F.replace("left_", wanted, F.lit("|"))).otherwise(F.col("left_")))
    rest = F.regexp_extract_all("left_", F.lit("<([a-z0-9_]+)>"), F.lit(1))
    return df.select("id", "sentences", F.col("named").alias("licences"), rest.alias("unclaimed"))


def oracle(table: str = "documents", id_column: str = "doc_id", content: str = "text") -> str:
    """The same findings as DuckDB SQL, lists as comma-joined text."""

    def known(s: str) -> str:
        # A joined text may end with the line end that closes its sentence.
        return "CASE " + " ".join(
            f"WHEN regexp_matches({s}, '^{_without_stops(pattern)}') THEN '{name}'".replace("$'", "\\n?$'") for name, pattern in SENTENCES
        ) + " END"

    steps, at = [], "found"
    for k, (licence, names) in enumerate(RULES):
        wanted = _sequence(names)
        steps.append(
            f"r{k} AS (SELECT id, sentences, CASE WHEN contains(rest, '{wanted}') AND NOT list_contains(named, '{licence}') "
            f"THEN list_append(named, '{licence}') ELSE named END AS named, replace(rest, '{wanted}', '|') AS rest FROM {at})"
        )
        at = f"r{k}"
    return f"""
    WITH cut AS (
        SELECT row_number() OVER () AS row, {id_column} AS id, CASE WHEN regexp_matches(lower({content}), '{ANYWHERE}') THEN string_split_regex(
            lower(regexp_replace({content}, '([.!?;:]) +', '\\1' || chr(10), 'g')), '\\r?\\n') ELSE [] END AS lines FROM {table}
    ), plain AS (
        SELECT row, id, lines, list_transform(lines, lambda s: trim(regexp_replace(regexp_replace(regexp_replace(
            s, '^\\s*(//+|/[*]+|--+)', ''), '[^a-z0-9./,-]+', ' ', 'g'), '[ .,]+( |$)', ' ', 'g'))) AS plain FROM cut
    ), pieces AS (
        SELECT row, id, plain, list_transform(range(1, len(lines) + 1), lambda k: plain[k] ||
            CASE WHEN plain[k] = '' OR regexp_matches(lines[k], '[.!?][^a-z0-9]*$') THEN chr(10) ELSE ' ' END) AS ended FROM plain
    ), starts AS (
        SELECT row, k, plain[k] AS s, array_to_string(ended[k:k + {WORDS - 1}], '') AS j
        FROM (SELECT row, plain, ended, unnest(range(1, len(plain) + 1)) AS k FROM pieces) WHERE regexp_matches(plain[k], '{STARTS}')
    ), named AS (
        SELECT row, k, coalesce(CASE WHEN regexp_matches(s, '{KEYWORDS}') THEN {known("s")} END, {known("j")}) AS name FROM starts
    ), found AS (
        SELECT id, coalesce(sentences, []) AS sentences, CAST([] AS VARCHAR[]) AS named,
            array_to_string(list_transform(coalesce(sentences, []), lambda x: '<' || x || '>'), '') AS rest
        FROM cut LEFT JOIN (SELECT row, list(name ORDER BY k) AS sentences FROM named WHERE name IS NOT NULL GROUP BY 1) USING (row)
    ), {", ".join(steps)}
    SELECT id AS doc_id, array_to_string(sentences, ',') AS sentences, array_to_string(named, ',') AS licences,
        array_to_string(regexp_extract_all(rest, '<([a-z0-9_]+)>', 1), ',') AS unclaimed FROM {at}"""
