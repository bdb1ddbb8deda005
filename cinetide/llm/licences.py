"""Licence scans by an exact set-similarity join of text blocks with templates.

Words are lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII
characters, over the whole text, whatever lines they stand on.  A template is a
public licence notice or its short form.  Its blocks are all runs of `window`
consecutive words, a quarter more than it has itself, so a short form can't be
put together from words far apart.  A block matches a template if it holds at least
`THRESHOLD` of the template's distinct words, its telling word, without which it may
be another licence's notice, and if neither it nor the `AFTER` words behind it hold a
word that makes it one; a short form must not be denied either, by a word of
`DENIALS` in the block or up to `BEFORE` words before it.  The document then gets the
template's label.  The base labels (the three phrases of consecutive words) always stay.

Method.  Words are ordered by their frequency over all documents, rarest
first.  A template of m distinct words of which a = ceil(THRESHOLD m) are needed:
* prefix filter: a match holds one of its m - a + 1 rarest words, so only
  places within a window of such a word are looked at;
* length filter: such a place must end a block that has a words of the template
  at least, repeated ones counted;
* positional filter: the template's words are looked up rarest first, and a block
  is dropped as soon as the words that are left can't bring it to a.
What passes is counted exactly, so the result is that of comparing all blocks
with all templates.

Scale: one scan for the frequencies of the templates' words (a fixed list, so
one row per word and task is aggregated) and one for the join, without a
shuffle of texts.  Templates are fixed and sent with the task.  Memory is linear
in a text, and each template costs a few passes over the words that it has too.

Defined results: a null text is empty (0 words, no labels, score 0); null ids and
repeated rows are scanned alike; a very long text is read whole; of equally good
templates the label is the same or both are given; an empty table gives an empty
result; other columns, also those named like the operator's own, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import ALNUM, LOWER, Words, chunks, hash_word, member
from .common import table

THRESHOLD = 0.8
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


#: Words that deny what a short form says, and how far before its block, and words that bar a template behind it, are looked for.
DENIALS = ("not", "never", "neither", "nor", "isn", "unlike", "incompatible", "instead")
BEFORE, AFTER = 4, 2


class Template(NamedTuple):
    """A notice in lower case: its label, a word that it must hold, words that it must not hold, and whether it is a short form."""

    label: str
    text: str
    telling: str | None = None
    barred: tuple[str, ...] = ()
    short: bool = False

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def denials(self) -> tuple[str, ...]:
        return DENIALS if self.short else ()

    @property
    def window(self) -> int:
        n = len(self.text.split())
        return n + n // 4


def short_forms(label: str, name: str, telling: str, barred: tuple[str, ...] = ()) -> tuple[Template, ...]:
    """The usual sentences that name a licence."""
    said = ("released under the {}", "licensed under the {}", "distributed under the {}")
    return tuple(Template(label, form.format(name), telling, barred, True) for form in said)


def identified(label: str, name: str, telling: str, barred: tuple[str, ...] = ()) -> Template:
    """A machine-readable identifier."""
    return Template(label, f"spdx license identifier {name}", telling, barred, True)


_OTHER_CC = ("noncommercial", "nc", "sharealike", "sa", "noderivatives", "noderivs", "nd")
_OTHER_GNU = ("lesser", "affero")
#: Public licence notices and their short forms.
TEMPLATES = (
    *short_forms("mit", "mit license", "mit", ("lincoln", "press")),
    identified("mit", "mit", "mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", None, ("boost", "font")),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
    ),
    Template("apache", "licensed under the apache license version 2 0", "apache", (), True),
    *short_forms("apache", "apache license", "apache"),
    identified("apache", "apache", "apache"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
        "basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache",
    ),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "gnu", _OTHER_GNU, True),
    *short_forms("gpl", "gnu general public license", "gnu", _OTHER_GNU),
    *short_forms("gpl", "gpl", "gpl"),
    *short_forms("gpl", "gnu gpl", "gpl"),
    identified("gpl", "gpl", "gpl"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu", _OTHER_GNU),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu",
        _OTHER_GNU,
    ),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser"),
    *short_forms("lgpl", "gnu lesser general public license", "lesser"),
    *short_forms("lgpl", "lgpl", "lgpl"),
    identified("lgpl", "lgpl", "lgpl"),
    Template("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "affero"),
    *short_forms("agpl", "gnu affero general public license", "affero"),
    *short_forms("agpl", "agpl", "agpl"),
    identified("agpl", "agpl", "agpl"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    *short_forms("mpl", "mozilla public license", "mozilla"),
    identified("mpl", "mpl", "mpl"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "nc", ("sa", "nd"), True),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial", ("sharealike", "noderivatives"), True),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "sa", ("nc",), True),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "sharealike", ("noncommercial",), True),
    Template("cc-by", "licensed under cc by 4 0", "cc", _OTHER_CC, True),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "attribution", _OTHER_CC, True),
    identified("cc-by", "cc by", "by", _OTHER_CC),
    identified("cc-by-sa", "cc by sa", "sa", ("nc",)),
    *short_forms("bsd", "bsd license", "bsd"),
    identified("bsd", "bsd", "bsd"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    *short_forms("isc", "isc license", "isc"),
    identified("isc", "isc", "isc"),
    *short_forms("boost", "boost software license", "boost"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization"),
    *short_forms("epl", "eclipse public license", "eclipse"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common"),
    *short_forms("eupl", "eupl", "eupl"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", (), True),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors"),
    Template("reserved", "all rights reserved"),
)


def needed(size: int) -> int:
    return ceil(THRESHOLD * size - 1e-9)


class Templates:
    """The templates' words in global order."""

    def __init__(self, frequency: dict[str, int], templates: tuple[Template, ...] = TEMPLATES):
        ranked = sorted(vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
        rank = {w: k for k, w in enumerate(ranked)}
        hashes = np.array([hash_word(w) for w in ranked], np.uint64)
        self.order = np.argsort(hashes)
        self.table = hashes[self.order]
        self.rows = [(t.label, t.window, sorted(rank[w] for w in t.words), rank.get(t.telling), sorted(rank[w] for w in t.barred), sorted(rank[w] for w in t.denials)) for t in templates]
        self.phrases = [(label, np.array([hash_word(w) for w in phrase.split()], np.uint64)) for phrase, label in PHRASES.items()]


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in (*t.words, *t.barred, *t.denials)})


def counted(batches: Iterable[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """How often the words stand in the batches: one row per word and task."""
    hashes = np.array([hash_word(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    sums = np.zeros(len(words), np.int64)
    for batch in batches:
        for _, buf, offs in chunks(batch):
            seen = Words(LOWER[buf], offs, ALNUM).hashes()
            seen = seen[member(seen, hashes[order])]
            sums += np.bincount(order[np.searchsorted(hashes[order], seen)], minlength=len(words))
    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(sums)], ["word", "n"])


def frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """Occurrences of the templates' words over all documents."""
    words = vocabulary(templates)
    rows = docs.select("text").mapInArrow(lambda it: counted(it, words), "word string, n bigint")
    return dict(rows.groupBy("word").agg(F.sum("n")).collect())  # one row per template word


def last_before(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each end the last of the places that is not behind it; -1 if there is none."""
    at = np.searchsorted(places, ends, "right") - 1
    return np.where(at >= 0, places[at], -1) if len(places) else np.full(len(ends), -1)


def notices_in(words: Words, templates: Templates) -> Iterator[tuple[int, int, str, float]]:
    """Text, template, label and containment of each template that some block of a text matches, at its best block."""
    hashes, doc = words.hashes(), words.doc_of_word()
    places = np.flatnonzero(member(hashes, templates.table))
    found = templates.order[np.searchsorted(templates.table, hashes[places])]
    by_rank = np.argsort(found, kind="stable")
    limits = np.searchsorted(found[by_rank], np.arange(len(templates.table) + 1))
    of = lambda r: places[by_rank[limits[r] : limits[r + 1]]]  # noqa: E731  a word's places in order
    for number, (label, window, ranks, telling, barred, denials) in enumerate(templates.rows):
        least = needed(len(ranks))
        rare = np.sort(np.concatenate([of(r) for r in ranks[: len(ranks) - least + 1]]))
        if not len(rare):
            continue
        ends = np.sort(np.concatenate([of(r) for r in ranks]))
        k = np.searchsorted(ends, ends - window, "right")  # the first of these words within the window
        ends = ends[np.arange(len(ends)) - k + 1 >= least]
        first = np.maximum(ends - window + 1, words.first[doc[ends]])
        near = last_before(rare, ends) >= first
        ends, first = ends[near], first[near]
        if telling is not None:
            told = last_before(of(telling), ends) >= first
            ends, first = ends[told], first[told]
        for r in barred:
            free = last_before(of(r), np.minimum(ends + AFTER, words.first[doc[ends] + 1] - 1)) < first
            ends, first = ends[free], first[free]
        for r in denials:
            free = last_before(of(r), ends) < np.maximum(first - BEFORE, words.first[doc[ends]])
            ends, first = ends[free], first[free]
        common = np.zeros(len(ends), np.int64)
        for n, r in enumerate(ranks, 1):
            common += last_before(of(r), ends) >= first
            can = common + len(ranks) - n >= least
            ends, first, common = ends[can], first[can], common[can]
            if not len(ends):
                break
        best = np.zeros(len(words.counts), np.int64)
        np.maximum.at(best, doc[ends], common)
        for d in np.flatnonzero(best).tolist():
            yield d, number, label, int(best[d]) / len(ranks)


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_templates bigint"


def phrases_in(words: Words, templates: Templates) -> Iterator[tuple[int, str, int]]:
    """Text, label and place (the word's number in the text) of each base phrase."""
    hashes, doc = words.hashes(), words.doc_of_word()
    for label, phrase in templates.phrases:
        k = len(phrase)
        if len(hashes) < k:
            continue
        at = np.flatnonzero(hashes[: len(hashes) - k + 1] == phrase[0])
        for j in range(1, k):
            at = at[hashes[at + j] == phrase[j]]
        for a in at[doc[at] == doc[at + k - 1]].tolist():
            yield int(doc[a]), label, a - int(words.first[doc[a]])


def scan(batches: Iterable[pa.RecordBatch], templates: Templates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offs in chunks(batch):
            words = Words(LOWER[buf], offs, ALNUM)
            n = part.num_rows
            places: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            more: list[set[str]] = [set() for _ in range(n)]
            score, matched = [0.0] * n, [0] * n
            for d, label, place in phrases_in(words, templates):
                places[d].append(place)
                base[d].add(label)
            for d, _, label, share in notices_in(words, templates):
                more[d].add(label)
                matched[d] += 1
                score[d] = max(score[d], share)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)], pa.string()),
                    pa.array(score, pa.float64()), pa.array(matched, pa.int64()),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )


def scanned(docs: DataFrame) -> DataFrame:
    templates = Templates(frequencies(docs))
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lambda it: scan(it, templates), SCHEMA)


def op8_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and best score alone."""
    return op8(spark, sf_dir).select("doc_id", "base_labels", "labels", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result by counting the distinct words of all blocks that end at a template's word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = ", ".join(f"({k}, '{t.label}', {t.words!r}, '{t.telling or ''}', {list(t.barred) or ['']!r}, {list(t.denials) or ['']!r}, {t.window}, {len(t.words)}, {needed(len(t.words))})" for k, t in enumerate(TEMPLATES))
    phrases = " union all ".join(
        f"select doc_id, '{label}' as label, unnest(list_filter(range(0, len(w)), lambda i: "
        + " and ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())) + ")) as place from whole"
        for phrase, label in PHRASES.items()
    )
    return f"""
with texts as (select doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') as t from documents),
whole as (select doc_id, regexp_extract_all(t, '{pattern}') as w from texts),
templates(t, label, words, telling, barred, denials, size, n, least) as (values {rows}),
known as (select t, unnest(words) as word, 'own' as kind from templates union all select t, unnest(barred), 'bar' from templates union all select t, unnest(denials), 'deny' from templates),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from whole),
places as (select doc_id, t, place, word, kind, telling, size, n, least, label from words join known using (word) join templates using (t)),
runs as (select doc_id, t, label, kind, n, least, telling, count(distinct case when kind = 'own' then word end) over r as common, count(case when word = telling and kind = 'own' then 1 end) over r as told,
  count(case when kind = 'bar' then 1 end) over b as bars, count(case when kind = 'deny' then 1 end) over d as denied from places window r as (partition by doc_id, t order by place range between size - 1 preceding and current row),
  b as (partition by doc_id, t order by place range between size - 1 preceding and {AFTER} following), d as (partition by doc_id, t order by place range between size - 1 + {BEFORE} preceding and current row)),
found as (select doc_id, t, label, max(common * 1.0::double / n) as share from runs where kind = 'own' and common >= least and (telling = '' or told > 0) and bars = 0 and denied = 0 group by all),
best as (select doc_id, max(share) as score, count(*) as n_templates from found group by 1),
phrases as ({phrases}),
base as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from phrases group by 1),
labels as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from found union select doc_id, label from phrases) group by 1)
select whole.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
  cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score,
  cast(coalesce(n_templates, 0) as bigint) as n_templates
from whole left join base using (doc_id) left join labels using (doc_id) left join best using (doc_id)"""


ORACLE_SQL = _sql()
NOTICES_SQL = f"select doc_id, base_labels, labels, score from ({ORACLE_SQL})"
