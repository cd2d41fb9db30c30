"""License scans with a positional rare-token index.

Words' document frequencies are counted over all documents.  The index has, for each
template, its words from the highest IDF down, with their places.  A template that
stands in a document has the support of most of its words, by IDF, at one relative
position; so at least one of its rarest words, those that hold the rest of the IDF,
must be there.  Their occurrences give the relative positions to look at, and at
each the postings of all words are intersected.  The mandatory phrases, without which a
licence isn't named, are verified first, since they cost one search of the text each.
The base phrases are counted at every place, whatever the index says."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise
from .words import LOWER

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and identifier of a licence.
SPDX = [
    ("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3.0"), ("agpl-3.0", "AGPL-3.0"), ("mpl-2.0", "MPL-2.0"),
    ("epl-2.0", "EPL-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("isc", "ISC"), ("bsl", "BSL-1.0"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("cc0", "CC0-1.0"), ("cc-by", "CC-BY-4.0"), ("cc-by-sa", "CC-BY-SA-4.0"),
]
#: Label, text of a licence or of the notice that names it, phrases that must stand in the document.
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ["permission is hereby granted free of charge", "to deal in the software without restriction"],
    ),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["apache license"]),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["apache license version 2 0", "unless required by applicable law or agreed to in writing"],
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ["general public license"]),
    (
        "gpl",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation""",
        ["general public license", "free software foundation"],
    ),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version.""",
        ["gnu general public license as published by the free software foundation either version 2 of the license"],
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
        ["gnu general public license as published by the free software foundation either version 3 of the license"],
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option)
        any later version.""",
        ["lesser general public license"],
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
        ["affero general public license"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" """,
        ["redistribution and use in source and binary forms", "with the distribution this software is provided by"],
    ),
    (
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
        ["redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ["permission to use copy modify and", "with or without fee is hereby granted"],
    ),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
        ["mozilla public license"],
    ),
    (
        "epl",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at http://www.eclipse.org/legal/epl-2.0""",
        ["eclipse public license"],
    ),
    ("bsl", "Distributed under the Boost Software License, Version 1.0.", ["boost software license"]),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely""",
        ["in no event will the authors be held liable", "alter it and redistribute it freely"],
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ["dedicated the work to the public domain"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0 international license"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["cc by sa"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    # openings of the licences themselves, as LICENSE files hold them
    (
        "apache-2.0",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
        1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.""",
        ["apache license version 2 0", "terms and conditions for use reproduction and distribution"],
    ),
    (
        "gpl-3.0",
        """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
        permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
        ["gnu general public license version 3 29 june 2007"],
    ),
    (
        "gpl-2.0",
        """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
        ["gnu general public license version 2 june 1991"],
    ),
    (
        "lgpl-3.0",
        """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
        permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser
        General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.""",
        ["gnu lesser general public license version 3 29 june 2007"],
    ),
    (
        "agpl-3.0",
        """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is
        permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.""",
        ["gnu affero general public license version 3 19 november 2007"],
    ),
    (
        "mpl-2.0",
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of,
        or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that
        particular Contributor's Contribution.""",
        ["mozilla public license version 2 0 1 definitions"],
    ),
    (
        "epl-2.0",
        """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR
        DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.""",
        ["eclipse public license v 2 0"],
    ),
    (
        "cc-by",
        """Creative Commons Attribution 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the
        terms and conditions of this Creative Commons Attribution 4.0 International Public License ("Public License").""",
        ["creative commons attribution 4 0 international public license", "by exercising the licensed rights"],
    ),
    (
        "cc-by-sa",
        """Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by
        the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License ("Public License").""",
        ["creative commons attribution sharealike 4 0 international public license", "by exercising the licensed rights"],
    ),
    # identifiers in files' first lines
    *((label, f"SPDX-License-Identifier: {name}", [f"spdx license identifier {' '.join(name.lower().replace('.', '-').split('-'))}"]) for label, name in SPDX),
]
SUPPORT = 0.6  # share of a template's IDF whose words must stand at one relative position
AT_ONCE = 1 << 18  # bytes of a text, or words compared, at once
#: Bytes of a word, after lower-casing A-Z: digits, a-z, and all above 0x7F.
PART = np.zeros(256, bool)
PART[48:58] = PART[97:123] = PART[128:] = True
SPACED = np.where(PART[LOWER], LOWER, 32).astype(np.uint8).tobytes()
SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, words binary, word string, n long"


def normal(text: str | None) -> bytes:
    """A text's words, A-Z lower-cased runs of digits, letters and bytes above 0x7F, each between two spaces."""
    spaced, out, at = (text or "").encode().translate(SPACED), [], 0
    while at < len(spaced):
        end = len(spaced) if len(spaced) - at <= AT_ONCE else spaced.find(b" ", at + AT_ONCE)
        end = len(spaced) if end < 0 else end
        if words := b" ".join(spaced[at:end].split()):
            out.append(words)
        at = end
    return b" " + b" ".join(out) + b" " if out else b" "



def places(words: bytes, wanted: bytes) -> Iterator[int]:
    """Index of the first word of each place where a phrase's words stand."""
    at, word, counted = words.find(wanted), 0, 0
    while at >= 0:
        word += words.count(b" ", counted, at)
        counted = at
        yield word
        at = words.find(wanted, at + 1)


def licence_words() -> set[bytes]:
    """The words of all templates: a fixed, small vocabulary."""
    return {w for _, text, _ in TEMPLATES for w in normal(text).split()}


class Index:
    """Postings of licence words: for each template its words, from the highest IDF, with their places."""

    def __init__(self, df: dict[bytes, int], documents: int):
        self.codes = {w: k for k, w in enumerate(sorted(licence_words()))}
        weight = {w: math.log((1 + documents) / (1 + df.get(w, 0))) + 1e-9 for w in self.codes}
        self.templates = []
        for label, text, must in TEMPLATES:
            words = normal(text).split()
            codes, weights = np.array([self.codes[w] for w in words]), np.array([weight[w] for w in words])
            rare, left = [], (1 - SUPPORT) * weights.sum() + 1e-9
            for w in sorted(set(words), key=lambda w: (-weight[w], w)):  # the fewest rare words without which the support is missed
                at = np.flatnonzero(codes == self.codes[w])
                rare.append((self.codes[w], at))
                left -= weights[at].sum()
                if left < 0:
                    break
            self.templates.append((label, codes, weights, rare, [normal(p) for p in must]))

    def labels(self, words: bytes) -> tuple[set[str], float]:
        """Labels of templates that stand in the document, and the best share of a template's words in place."""
        found, best = set(), 0.0
        able = [t for t in self.templates if all(p in words for p in t[4])]
        if not able:
            return found, best
        doc = np.fromiter((self.codes.get(w, -1) for w in words.split()), np.int32, words.count(b" ") - 1)
        for label, codes, weights, rare, _ in able:
            starts = np.unique(np.concatenate([(np.flatnonzero(doc == c)[:, None] - at[None, :]).ravel() for c, at in rare]))
            step = max(1, AT_ONCE // len(codes))
            for a in range(0, len(starts), step):
                where = starts[a : a + step, None] + np.arange(len(codes))[None, :]
                same = (where >= 0) & (where < len(doc))
                same &= doc[np.clip(where, 0, len(doc) - 1)] == codes[None, :]
                good = same @ weights >= SUPPORT * weights.sum()
                if good.any():
                    found.add(label)
                    best = max(best, float(same[good].mean(1).max()))
        return found, best


def _find(batches):
    """Base columns of each row, its words where a licence is named, and the task's document frequencies."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    wanted, df, documents = licence_words(), Counter(), 0
    base = {label: normal(p) for p, label in BASE.items()}
    must = sorted({p for _, _, every in TEMPLATES for p in map(normal, every)})
    for batch in batches:
        documents += len(batch)
        out = []
        for text in batch.column(1):
            words = normal(text.as_py())
            df.update(wanted.intersection(words.split()))
            at = {label: list(places(words, p)) for label, p in base.items() if p in words}
            starts = [i for x in at.values() for i in x]
            named = any(p in words for p in must)
            out.append((words.count(b" ") - 1, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(at)), words if named else None))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        m = len(batch)
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64())], names)
    m = len(df) + 1  # an empty word stands for the number of documents
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    yield pa.record_batch([*(pa.nulls(m, k) for k in kinds), pa.array(["", *(w.decode() for w in df)], pa.string()), pa.array([documents, *df.values()], pa.int64())], names)


def _judge(held):
    def run(batches):
        index = Index(*held.value)
        for batch in batches:
            labels, scores = [], []
            for own, words in zip(batch.column("base_labels").to_pylist(), batch.column("words"), strict=True):
                own = set(filter(None, own.split(",")))
                more, score = index.labels(words.as_py()) if words.is_valid else (set(), 0.0)
                labels.append(",".join(sorted(own | more)))
                scores.append(min(1.0, max(score, 0.5 if own else 0.0)))
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [x.split()[0] for x in SCAN.split(", ")])

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    A null or empty text has no words, no places and no labels.  labels adds the
    method's to the base ones; score is the share of the best template's words in
    place, at least 0.5 with a base label, else 0.  Repeated rows are answered each; an
    empty table gives an empty one.  Texts are read once; the words of those that name a
    licence are kept for the index, which needs the document frequencies of all rows.
    The driver gets one number for each licence word."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialise(rows.mapInArrow(_find, FOUND), "licences")
    counted = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word.encode(): r.n for r in counted}
    held = docs.sparkSession.sparkContext.broadcast((df, df.pop(b"", 0)))
    return found.where("word is null").drop("word", "n").mapInArrow(_judge(held), SCAN)
