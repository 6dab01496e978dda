"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are notices, headers and whole licence texts. A text is compared whole, as a licence file, and by
stretches of lines, as a header: from each line with a telling term of a template a stretch grows by neighbouring
lines as long as its cosine rises, across line breaks, comment marks and empty lines. Vectors are sparse, over
the templates' terms; how rare a term is comes from the lines of all documents. A template is left out for a text,
and a line as a start, only where the terms that are there cannot reach the least cosine. The likest
stretch gives a file its own licence; licences that come close are told apart by the terms that only one has. A text that opens with a licence's title is that licence's whole text. A file that is little else than such stretches is a licence file, and
files without a licence of their own take that of the nearest directory above them that has one: paths are
split into their ancestors and joined to the licensed directories, deepest first.

Defined results: a stretch needs two different terms of a template, and one of the template's numbers if it has any; a null or empty text has no licence of its
own and may inherit; a null path has no directory; a tie that no term decides goes to the likest, then to the first name, between licence files of
a directory to the higher likeness and then the first name; repeated rows are judged alike, one by one; an empty table gives
an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import spread, stash

# Notices, headers and whole texts by which public licences are named.
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSEMENT = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_GNU = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.
You should have received a copy of the GNU {kind} along with this {work}. If not, see <https://www.gnu.org/licenses/>."""
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEMPLATES = {
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", _GNU.format(work="program", kind=_AGPL, version=3)),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", _APACHE),
    "BSD-2-Clause": ("Redistribution and use are permitted under the BSD 2-Clause Simplified License", f"{_REDISTRIBUTION}\n{_DISCLAIMER}"),
    "BSD-3-Clause": ("Redistribution and use are permitted under the BSD 3-Clause New or Revised License", f"{_REDISTRIBUTION}\n{_ENDORSEMENT}\n{_DISCLAIMER}"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", _GNU.format(work="program", kind=_GPL, version=2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", _GNU.format(work="program", kind=_GPL, version=3)),
    "ISC": ("Released under the ISC License", _ISC),
    "LGPL-2.0": ("This library is licensed under the GNU Library General Public License, version 2", _GNU.format(work="library", kind="Library General Public License", version=2)),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1", _GNU.format(work="library", kind=_LGPL, version=2.1)),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", _GNU.format(work="library", kind=_LGPL, version=3)),
    "MIT": ("Released under the MIT License", _MIT),
    "MPL-2.0": ("This file is subject to the terms of the Mozilla Public License, version 2.0", _MPL),
}
# The titles with which whole licence texts open, also of some licences without a template.
TITLES = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "Artistic-1.0": 'The "Artistic License"',
    "GFDL-1.2": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GPL-1.0": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.0": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-1.1": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
#: Lines of a text among which its title stands.
OPENING = 4
#: Least cosine of a stretch of lines to a template.
LEAST = 0.6
#: Licences whose cosines lie this near are told apart by the terms that only one of them has.
CLOSE = 0.2
#: A document is a licence file if its stretches hold at least this share of its words.
FILE_SHARE = 0.5
#: Lines that a stretch may take in at a step, so that one unlike line does not end it.
REACH = 3

#: A licence has one text or several.
Templates = dict[str, str | tuple[str, ...]]

TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()]


def _texts(templates: Templates) -> list[tuple[str, str]]:
    """(name, text) of each template, in the order of names."""
    return [(name, text) for name in sorted(templates) for text in ([templates[name]] if isinstance(templates[name], str) else templates[name])]


def document_frequency(docs: DataFrame, text_col: str = "text", templates: Templates = TEMPLATES) -> tuple[int, dict[str, int]]:
    """The number of lines of all documents, and of lines with each of the templates' terms."""
    vocabulary = frozenset(t for _, s in _texts(templates) for t in terms(s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in _lines(text):
                    n += 1
                    found.update(vocabulary.intersection(terms(line)))
        found[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "term string, n long")
    rows = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the templates' terms at most
    return rows.pop("", 0), rows


class Template:
    """A template's unit vector and its telling terms, the rarest: without one of them no cosine reaches the least."""

    def __init__(self, name: str, text: str, idf: dict[str, float], least: float):
        weight = {t: n * idf[t] for t, n in Counter(terms(text)).items()}
        norm = sum(w * w for w in weight.values()) ** 0.5
        self.name, self.vector, self.telling = name, {t: w / norm for t, w in weight.items()}, set()
        self.versions = {t for t in weight if t[0].isdigit()}
        rest = 1.0
        for t in sorted(weight, key=lambda t: (-idf[t], t)):
            if rest < (least - 1e-9) ** 2:
                break
            self.telling.add(t)
            rest -= self.vector[t] ** 2

    def reachable(self, present: frozenset[str]) -> float:
        """The most that a stretch of a text with these terms can reach."""
        return sum(w * w for t, w in self.vector.items() if t in present) ** 0.5


class Stretch:
    """Lines taken together, with their cosine to one template."""

    def __init__(self, template: Template, match: Matcher, count: Counter, whole: bool = False):
        self.template, self.match, self.whole, self.count, self.dot, self.square = template, match, whole, Counter(), 0.0, 0.0
        self.add(count)

    def _with(self, more: Counter) -> tuple[float, float]:
        dot, square = self.dot, self.square
        for t, n in more.items():
            idf = self.match.idf.get(t)
            if idf is None:
                # Among few lines such a word adds its idf and not the square, so that names and years do not hide a header.
                square += (n * self.match.other) ** 2 if self.whole else n * self.match.other
            else:
                c = self.count[t]
                dot += n * idf * self.template.vector.get(t, 0.0)
                square += ((c + n) ** 2 - c * c) * idf * idf
        return dot, square

    def cosine(self, more: Counter = Counter()) -> float:
        """The cosine, also as it would be with the terms of further lines."""
        dot, square = self._with(more)
        return min(1.0, dot / square**0.5) if square else 0.0

    def add(self, more: Counter) -> None:
        self.dot, self.square = self._with(more)
        self.count += more

    def counts(self) -> bool:
        """Whether it has two terms of the template, and one of its numbers if it has any: another version is another licence."""
        versions = self.template.versions
        return sum(t in self.template.vector for t in self.count) >= 2 and (not versions or not versions.isdisjoint(self.count))


class Matcher:
    """Holds texts against the templates, with one idf for terms outside them."""

    def __init__(self, lines: int, frequency: dict[str, int], templates: Templates = TEMPLATES, least: float = LEAST):
        self.least = least
        self.idf = {t: log((1 + lines) / (1 + frequency.get(t, 0))) + 1 for _, s in _texts(templates) for t in terms(s)}
        self.other = log(1 + lines) + 1  # a word that no line shares
        self.vocabulary = frozenset(self.idf)
        self.titles = {name: " ".join(terms(title)) for name, title in TITLES.items() if name in templates or templates is TEMPLATES}
        self.templates = [Template(name, text, self.idf, least) for name, text in _texts(templates) if terms(text)]

    def _grown(self, template: Template, lines: list[str], i: int) -> tuple[Stretch, int, int]:
        """The stretch that grows from line ``i``, and its borders."""
        low, high = i, i + 1
        stretch = Stretch(template, self, Counter(terms(lines[i])))
        now = stretch.cosine()
        while True:
            best = None
            for up in (True, False):
                more = Counter()
                for k in range(1, REACH + 1):
                    at = low - k if up else high + k - 1
                    if not 0 <= at < len(lines):
                        break
                    more.update(terms(lines[at]))
                    then = stretch.cosine(more)
                    if then > now + 1e-9 and (best is None or then > best[0]):
                        best = then, up, k, more.copy()
            if best is None:
                return stretch, low, high
            now, up, k, more = best
            stretch.add(more)
            low, high = (low - k, high) if up else (low, high + k)

    def _title(self, lines: list[str]) -> str | None:
        """The licence whose title, and no longer one's, begins one of the first lines and goes on in the next ones."""
        found = None
        for i in range(min(OPENING, len(lines))):
            opening = " ".join(t for line in lines[i:OPENING] for t in terms(line))
            for name, title in self.titles.items():
                if f"{opening} ".startswith(f"{title} ") and (found is None or len(title) > len(self.titles[found])):
                    found = name
        return found

    def _duel(self, a: tuple[float, Stretch], b: tuple[float, Stretch]) -> str:
        """Which of two licences a text has, by the share of the terms of one alone that the text's stretches hold; the likest so far if that is equal."""

        def shown(own: Stretch, other: Stretch) -> float | None:
            alone = [t for t in own.template.vector if t not in other.template.vector]
            weight = sum(self.idf[t] for t in alone)
            return sum(self.idf[t] for t in alone if t in a[1].count or t in b[1].count) / weight if weight else None

        x, y = shown(a[1], b[1]), shown(b[1], a[1])
        if x is None or y is None:  # one has no terms of its own: the other's must show
            return (a if (y if x is None else 1 - x) < 0.5 else b)[1].template.name
        return (a if x >= y else b)[1].template.name

    def judge(self, text: str) -> tuple[str | None, float, bool]:
        """The licence of a text, its likeness, and whether the text is little else."""
        name, most, whole = self._judge(text)
        title = self._title(_lines(text)[:OPENING])
        return (title, 1.0, True) if title else (name, most, whole)

    def _judge(self, text: str) -> tuple[str | None, float, bool]:
        present = self.vocabulary.intersection(terms(text))
        live = [t for t in self.templates if t.reachable(present) >= self.least - 1e-9] if len(present) > 1 else []
        if not live:
            return None, 0.0, False
        lines, whole = _lines(text), Counter(terms(text))
        likest: dict[str, tuple[float, Stretch]] = {}
        covered = set()
        for template in live:
            starts = []
            for i, line in enumerate(lines):
                count = Counter(terms(line))
                if not template.telling.isdisjoint(count):
                    starts.append((-Stretch(template, self, count).cosine(), i))
            found, taken = [(Stretch(template, self, whole, True), 0, len(lines))], set()
            for _, i in sorted(starts):
                if i not in taken:
                    found.append(self._grown(template, lines, i))
                    taken.update(range(*found[-1][1:]))
            for stretch, low, high in found:
                cosine = stretch.cosine()
                if cosine >= self.least and stretch.counts():
                    covered.update(range(low, high))
                    if template.name not in likest or cosine > likest[template.name][0]:
                        likest[template.name] = cosine, stretch
        order = sorted(likest, key=lambda name: (-likest[name][0], name))
        best = order[0] if order else None
        for name in order[1:]:
            if likest[order[0]][0] - likest[name][0] <= CLOSE:
                best = self._duel(likest[best], likest[name])
        most = likest[best][0] if best else 0.0
        words = [len(line.split()) for line in lines]
        return best, most, bool(best) and sum(words[i] for i in covered) >= FILE_SHARE * sum(words)


def scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: Templates = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, path, own_license, likeness, is_license_file) of every row, from its own text."""
    lines, frequency = document_frequency(docs, text_col, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(lines, frequency, templates, least)
        for batch in batches:
            out = [match.judge(text) for text in batch.column(2).to_pylist()]
            name, cosine, whole = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(cosine, pa.float64()), pa.array(whole, pa.bool_())],
                ["doc_id", "path", "own_license", "likeness", "is_license_file"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, path string, own_license string, likeness double, is_license_file boolean")


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds ``license`` and ``from_dir``: the own one, else that of the nearest ancestor directory with a licence file.

    Directories, not files, are joined to their ancestors: a directory of any number of files is one row.
    """
    found = stash(scanned.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)), "license-scan")
    licensed = found.filter("is_license_file AND path IS NOT NULL").groupBy("dir").agg(
        F.min(F.struct((-F.col("likeness")).alias("l"), F.col("own_license").alias("name"))).getField("name").alias("dir_license")
    )
    dirs = found.filter("own_license IS NULL AND path IS NOT NULL").select(F.col("dir").alias("below")).distinct()
    # From the directory itself up to the root, which is the empty path; an empty path has no parts.
    dirs = dirs.withColumn("parts", F.when(F.col("below") == "", F.array().cast("array<string>")).otherwise(F.split("below", "/")))
    up = dirs.select("below", "parts", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("up"))
    up = up.select("below", "up", F.array_join(F.slice("parts", F.lit(1), F.size("parts") - F.col("up")), "/").alias("dir"))
    near = up.join(licensed, "dir").withColumn("r", F.row_number().over(Window.partitionBy("below").orderBy("up"))).filter("r = 1")
    near = near.select(F.col("below").alias("dir"), F.col("dir").alias("from_dir"), "dir_license")
    columns = ["doc_id", "path", "own_license", "likeness", "is_license_file", F.coalesce("own_license", "dir_license").alias("license"), "from_dir"]
    # Only files that may inherit are joined; a directory of very many of them is dealt to many tasks.
    may = F.col("own_license").isNull() & F.col("path").isNotNull()
    heirs = spread(found.filter(may), near, "dir", "left").select(*columns)
    rest = found.filter(~may).withColumns({"from_dir": F.lit(None).cast("string"), "dir_license": F.lit(None).cast("string")}).select(*columns)
    return heirs.unionByName(rest)
