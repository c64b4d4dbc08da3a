"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Of each whole text the lines and blocks (runs of lines without a blank one) that speak of rights are cut into terms, and so is the
whole text of a licence file. Each is a sparse vector, weighted by the templates' inverse document frequency, and meets the templates
in a join on the term (the templates are a fixed table of a few hundred terms). Other words beside a notice dilute it, and a notice
may go on in the next line; so each short template also meets windows of a block: they begin and end with a term of it, are up to
EXTRA terms longer, and hold a mark of it, a term that fewest licences have. A longer template meets windows of its own length that begin
where one of its first LEADING terms stands in its place; a long notice without any of these is found by its lines and blocks only. A file's own licence is its best unit's or window's, from
a cosine of THRESHOLD on. A directory's licence is the best of its licence files; a file without one takes that
of the nearest directory above that has one, by a join on paths of distinct directories only.

Nulls and empty texts have no units. Rows without a path belong to no directory. Ties go to the smaller licence name. Repeated
rows are files like others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import let
from tessera.plans.staging import staged

#: Phrases by which licences are announced.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal public domain dedication", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved", "Copyright. All rights reserved. No part may be reproduced without permission", "Proprietary and confidential"],
}
#: Texts of licences and of the notices that stand at the head of files.
TEXTS = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
#: What a line or block that speaks of rights has.
SPEAKS = r"(?i)licen[sc]e|spdx|copyright|all[\s#*/]+rights[\s#*/]+reserved|public[\s#*/]+domain|permission[\s#*/]+is[\s#*/]+hereby|hereby[\s#*/]+granted|redistribution[\s#*/]+and[\s#*/]+use|creative[\s#*/]+commons|\bcc0\b|\bcc[\s#*/]+by|proprietary"
TERM = r"[A-Za-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.6
#: Terms that a short template's window has beyond the template's at most; terms of the longest short template; first terms of a longer
#: one, each of which tells where a window may begin.
EXTRA, SHORT, LEADING = 4, 24, 4
LINE, BLOCK, FILE = 0, 1, 2


def terms_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def template_lines() -> list[tuple[str, str, str]]:
    """(template, licence, text) of all templates."""
    return [(f"{name} {k}", name, line) for name in sorted(TEMPLATES.keys() | TEXTS.keys()) for k, line in enumerate([*TEMPLATES.get(name, []), *TEXTS.get(name, [])])]


def template_marks() -> dict[str, tuple[list[str], list[str]]]:
    """Terms and marks of each template."""
    terms = {template: (name, re.findall(TERM, line.lower())) for template, name, line in template_lines()}
    holders: dict[str, set[str]] = {}
    for name, own in terms.values():
        for t in own:
            holders.setdefault(t, set()).add(name)
    fewest = {template: min(len(holders[t]) for t in own) for template, (_, own) in terms.items()}
    return {template: (own, sorted({t for t in own if len(holders[t]) == fewest[template]})) for template, (_, own) in terms.items()}


def least_shared(threshold: float) -> dict[str, int]:
    """How many different terms of each template a unit must have at least for a cosine of ``threshold``: a cosine is at most the length
    of the part of the template's unit vector that is shared."""
    own = {template: Counter(re.findall(TERM, line.lower())) for template, _, line in template_lines()}
    holders = Counter(t for terms in own.values() for t in terms)
    out = {}
    for template, terms in own.items():
        squares = sorted(((n * (math.log((1.0 + len(own)) / (1 + holders[t])) + 1)) ** 2 for t, n in terms.items()), reverse=True)
        upto = list(accumulate(squares))
        out[template] = next(k + 1 for k, x in enumerate(upto) if x >= (threshold - 1e-6) ** 2 * upto[-1] - 1e-9)
    return out


def windows_of(blocks: DataFrame, threshold: float) -> DataFrame:
    """Rows (row, unit, template, at, size, terms) from rows (row, unit, terms): the windows that may have a cosine of ``threshold`` to a
    short template, which are up to a little over its length. The work is linear in a block's length."""
    short = {template: (own, marks) for template, (own, marks) in template_marks().items() if len(own) <= SHORT}
    shared = least_shared(threshold)
    words = lambda own: F.array(*(F.lit(t) for t in sorted(set(own))))
    terms, longest = F.col("terms"), max(len(own) for own, _ in short.values()) + EXTRA
    marked = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: F.array_contains(words(m for _, marks in short.values() for m in marks), F.get(terms, i)))
    around = F.array_sort(F.array_distinct(F.flatten(F.transform(marked, lambda i: F.sequence(F.greatest(F.lit(0), i - longest + 1), F.least(F.size(terms) - 1, i + longest - 1))))))
    places = blocks.select("row", "unit", "terms", F.when(F.size(terms) > 0, around).alias("places"))

    def windows(template: str, own: list[str], marks: list[str]) -> Column:
        def pairs(ends: Column) -> Column:
            window = lambda a, b: F.struct(F.lit(template).alias("template"), a.alias("at"), (b - a + 1).alias("size"), F.slice(terms, a + 1, b - a + 1).alias("terms"))
            # in order: from each end only so many others are within reach
            return F.flatten(F.transform(ends, lambda a, k: F.transform(F.filter(F.slice(ends, k + 1, len(own) + EXTRA), lambda b: b < a + len(own) + EXTRA), lambda b: window(a, b))))

        ends = F.filter(F.coalesce("places", F.array().cast("array<int>")), lambda i: F.array_contains(words(own), F.get(terms, i)))
        return F.filter(let(ends, pairs), lambda w: (F.size(F.array_intersect(w["terms"], words(own))) >= shared[template]) & F.arrays_overlap(w["terms"], words(marks)))

    return places.select("row", "unit", F.inline(F.concat(*(windows(t, own, marks) for t, (own, marks) in short.items()))).alias("template", "at", "size", "terms"))


def long_scores(blocks: DataFrame, threshold: float, weights: list, unseen: float) -> DataFrame:
    """Rows (row, licence, score) from rows (row, unit, terms): the best window's cosine to each longer template, from ``threshold`` on. A
    template meets the windows of its length that begin where one of its first LEADING terms stands in its place. A window's neighbours
    share most of its terms, so its vector is summed where it stands, and only scores leave a row. ``weights``: template_weights() rows."""
    long = {template: x for template, x in template_marks().items() if len(x[0]) > SHORT}
    shared, terms = least_shared(threshold), F.col("terms")
    words = lambda own: F.array(*(F.lit(t) for t in sorted(set(own))))
    idf = F.create_map(*(F.lit(x) for r in {r.term: r for r in weights}.values() for x in (r.term, r.idf)))
    leading = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: F.array_contains(words(t for own, _ in long.values() for t in own[:LEADING]), F.get(terms, i)))
    places = blocks.select("row", "unit", "terms", F.when(F.size(terms) > 0, leading).alias("leading"))

    def starts(template: str, own: list[str], marks: list[str]) -> Column:
        cut = lambda a: F.slice(terms, a + 1, len(own))
        begins = lambda k: F.transform(F.filter("leading", lambda i: (F.get(terms, i) == own[k]) & (i >= k)), lambda i: i - k)
        told = lambda a: (F.size(F.array_intersect(cut(a), words(own))) >= shared[template]) & F.arrays_overlap(cut(a), words(marks))
        every = F.coalesce(F.array_distinct(F.concat(*(begins(k) for k in range(LEADING)))), F.array().cast("array<int>"))
        return F.transform(F.filter(every, told), lambda a: F.struct(F.lit(template).alias("template"), cut(a).alias("terms")))

    found = places.select("row", F.inline(F.concat(*(starts(t, *x) for t, x in long.items()))).alias("template", "window"))
    of = F.create_map(*(x for t in long for x in (F.lit(t), F.create_map(*(F.lit(y) for r in weights if r.template == t for y in (r.term, r.weight))))))
    counted = F.transform(F.array_distinct("window"), lambda t: F.struct(t.alias("t"), (F.size("window") - F.size(F.array_remove("window", t))).cast("double").alias("n")))
    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"))

    def added(acc: Column, x: Column) -> Column:
        w = x["n"] * F.coalesce(F.element_at(idf, x["t"]), F.lit(unseen))
        return F.struct((acc["dot"] + w * F.coalesce(F.element_at("own", x["t"]), F.lit(0.0))).alias("dot"), (acc["square"] + w * w).alias("square"))

    sums = found.withColumn("own", F.element_at(of, F.col("template"))).select("row", "template", F.aggregate(counted, zero, added).alias("s"))
    name = F.create_map(*(F.lit(x) for r in {r.template: r for r in weights}.values() for x in (r.template, r.licence)))
    return sums.select("row", F.element_at(name, F.col("template")).alias("licence"), F.round(F.col("s.dot") / F.sqrt("s.square"), 9).alias("score")).where(F.col("score") >= threshold)


def template_weights(spark) -> tuple[DataFrame, float]:
    """Rows (term, template, licence, weight, idf) of unit-length template vectors; the idf of a term that no template has."""
    rows = template_lines()
    table = spark.createDataFrame(rows, "template string, licence string, line string")
    tf = table.select("template", "licence", F.explode(terms_of(F.col("line"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + len(rows)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weighed = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "template").select("term", "template", "licence", (F.col("w") / F.col("norm")).alias("weight"), "idf"), math.log(1.0 + len(rows)) + 1


def units_of(text: Column, is_licence_file: Column) -> Column:
    """Array of struct(kind, x): the lines and blocks of a text that speak of rights, and a licence file's whole text."""
    speaking = lambda parts, kind: F.transform(F.filter(parts, lambda x: x.rlike(SPEAKS)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    whole = F.filter(F.array(F.struct(F.lit(FILE).alias("kind"), text.alias("x"))), lambda u: is_licence_file)
    found = F.concat(speaking(F.split(text, "\n"), LINE), speaking(F.split(text, r"\n[\x20\t\r]*\n"), BLOCK), whole)
    return F.coalesce(F.when(text.rlike(SPEAKS), found), F.array().cast("array<struct<kind:int,x:string>>"))


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (row, licence, score) from rows (row, units): the best unit or window of each row that has one."""
    weights, unseen = template_weights(files.sparkSession)
    weights = staged(weights, "templates")  # fixed: a few hundred rows
    key = ["row", "unit", "meets", "at", "size"]  # a whole unit meets all templates
    each = files.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.kind", terms_of(F.col("u.x")).alias("terms"))
    each = staged(each, "terms")  # few texts speak of rights
    units = each.select("row", "unit", F.lit("").alias("meets"), F.lit(0).alias("at"), F.lit(0).alias("size"), "terms").union(windows_of(each.where(F.col("kind") == BLOCK), threshold))
    tf = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    met = tf.join(F.broadcast(weights.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "licence", "weight")).alias("in"))), "term", "left")
    met = met.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = met.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = met.select(*key, "w", F.inline("in")).where((F.col("meets") == "") | (F.col("meets") == F.col("template")))
    dots = dots.groupBy(*key, "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, key).select("row", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    scored = scored.union(long_scores(each.where(F.col("kind") == BLOCK), threshold, weights.collect(), unseen))
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def parents(folder: Column) -> Column:
    """The folder and all above it, nearest first; the root is the empty path."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda up: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - up), "/").alias("ancestor"), up.alias("up")))


def scanned(files: DataFrame, keep: list[str], path: Column, text: Column, is_licence_file: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep``, then own_licence, score, licence, inherited_from (a folder, or null) and steps_up (0 is the file's own folder), one row
    for each file. Kept columns of these names give way."""
    keep = [c for c in keep if c not in ("own_licence", "score", "licence", "inherited_from", "steps_up")]
    folder = F.array_join(F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda x: x != ""), "/")
    is_file = F.coalesce(is_licence_file, F.lit(False))
    rows = files.select(*keep, folder.alias("__ts_folder"), is_file.alias("__ts_file"), units_of(text, is_file).alias("__ts_units"))
    rows = staged(rows.withColumn("__ts_row", F.monotonically_increasing_id()), "speaking")
    own = own_licences(rows.where(F.size("__ts_units") > 0).select(F.col("__ts_row").alias("row"), F.col("__ts_units").alias("units")), threshold).select(F.col("row").alias("__ts_of"), F.col("licence").alias("__ts_licence"), F.col("score").alias("__ts_score"))
    found = staged(rows.drop("__ts_units").join(own, rows["__ts_row"] == own["__ts_of"], "left").drop("__ts_of"), "own")
    held = found.where("__ts_file and __ts_licence is not null and __ts_folder is not null").groupBy(F.col("__ts_folder").alias("holder")).agg(F.min(F.struct((-F.col("__ts_score")).alias("minus"), "__ts_licence")).alias("b")).select("holder", F.col("b.__ts_licence").alias("held"))
    folders = found.where("__ts_folder is not null").groupBy("__ts_folder").agg(F.count(F.lit(1)).alias("files"))
    climbed = folders.select(F.col("__ts_folder").alias("folder"), F.explode(parents(F.col("__ts_folder"))).alias("p")).select("folder", "p.*")
    nearest = climbed.join(held, climbed.ancestor == held.holder).groupBy("folder").agg(F.min(F.struct("up", "holder", "held")).alias("n")).select(F.col("folder").alias("__ts_at"), F.col("n.holder").alias("__ts_holder"), F.col("n.held").alias("__ts_held"), F.col("n.up").alias("__ts_up"))
    out = found.join(nearest, found["__ts_folder"] == nearest["__ts_at"], "left")
    inherits = F.col("__ts_licence").isNull()
    return out.select(*keep, F.col("__ts_licence").alias("own_licence"), F.col("__ts_score").alias("score"), F.coalesce("__ts_licence", "__ts_held").alias("licence"), F.when(inherits, F.col("__ts_holder")).alias("inherited_from"), F.when(inherits, F.col("__ts_up")).alias("steps_up"))
