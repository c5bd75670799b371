"""Licence scan: canonical digests of entire texts, joined to those of known licences.

Canonical form: lower case; lines that state a copyright (the word with a year, a sign or a placeholder after it, or the sign
itself) and lines that only say that all rights are reserved dropped; runs of anything but letters and digits become one
space; equivalent spellings become one. Two texts with equal canonical forms have equal SHA-256 digests, so a join on the
digest finds them, however their lines are broken elsewhere. Known are whole licences, by text or by digest alone, and the
one-line notices that stand for them; a document is looked up as a whole, and each of its lines as well, as notices stand
inside other text.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Up to so many known digests are sent to all executors; the lines' digests meet a larger table in a shuffled join.
MAX_KNOWN = 100_000
_STATEMENT = r"(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|\[|<|\{|by\b)|\(c\)[ \t]*(?:copyright\b|[0-9]{4})|©)"
_COPYRIGHT = re.compile(rf"^[ \t#*/;%-]*+(?:{_STATEMENT}[^\n]*|all rights reserved[ \t.]*)$", re.M)
_BREAK = re.compile(r"[\W_]+")
_DIGESTS_HELD = 500_000

# Spellings that licence matching guidelines treat as equal, each to its first form.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations",
    "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "honour": "honor", "initialise": "initialize", "labour": "labor", "merchantibility": "merchantability",
    "modernise": "modernize", "recognise": "recognize", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "fulfil": "fulfill", "centre": "center", "catalogue": "catalog",
    "analogue": "analog", "acknowledgement": "acknowledgment", "judgement": "judgment", "programme": "program", "noncommercial": "non commercial", "http": "https",
}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Licence texts and notices.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


# Digests of the canonical forms of whole licences in their published layout, by SPDX name.
DIGESTS = (
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
)


def canonical(text: str) -> str:
    low = text.lower()
    if "copyright" in low or "(c)" in low or "©" in low or "all rights reserved" in low:
        low = _COPYRIGHT.sub("", low)
    return " ".join([SPELLINGS.get(w, w) for w in _BREAK.sub(" ", low).split()])


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode("utf-8", "surrogatepass")).hexdigest()


def known_rows(licences=KNOWN, digests=DIGESTS) -> list[tuple[str, str]]:
    """(digest, licence_id) of (licence_id, text) and (licence_id, digest) pairs; of licences with equal texts, the first by name."""
    return sorted(dict(sorted([*((digest(text), name) for name, text in licences), *((d, name) for name, d in digests)], reverse=True)).items())


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_rows(), "digest string, licence_id string")


def known_at(spark: SparkSession, path: str) -> DataFrame:
    """digest, licence_id of a folder of texts, one licence a file, named after the file without its .txt."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.txt$", "")
    files = spark.read.text(path, wholetext=True).select(name.alias("licence_id"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in batch.column(1).to_pylist()], pa.string()), batch.column(0)], ["digest", "licence_id"])

    return files.mapInArrow(run, "digest string, licence_id string")


def scan(docs: DataFrame, table: DataFrame | None = None, max_known: int = MAX_KNOWN) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words (of the canonical form), digest, licence_id (of the entire
    text, else null), n_notices (lines that are a known text), notices (their licences, sorted, comma-joined).

    table: (digest, licence_id), by default that of KNOWN and DIGESTS. A null or empty text, and one of copyright lines only,
    has the digest of the empty text, which is never a licence. Repeated rows, null ids and other columns (left out) are fine.
    A text is read in time in proportion to its length, and held whole. max_known changes the plan, not the result: beyond it
    the distinct lines of distinct texts meet the table by digest.
    """
    spark = docs.sparkSession
    table = (known(spark) if table is None else table).where(F.col("digest") != digest("")).groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    table = stored(table, "licences")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    few = table.limit(max_known + 1).count() <= max_known
    lines = spark.sparkContext.broadcast({bytes.fromhex(r.digest): r.licence_id for r in table.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = lines.value or {}
        for batch in batches:
            many, digests, keys, counts, names = [], [], [], [], []
            for value in batch.column(1).to_pylist():
                text = value or ""
                form = canonical(text)
                many.append(len(form.split(" ")) if form else 0)
                digests.append(hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest())
                keys.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                found = []
                if notices:
                    for line in text.split("\n"):
                        if line and (hit := notices.get(bytes.fromhex(digest(line)))):
                            found.append(hit)
                counts.append(len(found))
                names.append(",".join(sorted(set(found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(many, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(names, pa.string())],
                ["doc_id", "n_words", "digest", "text_key", "n_notices", "notices"],
            )

    def each_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_key, digest, n): the lines of a partition's distinct texts."""
        seen: set[bytes] = set()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                text = value or ""
                key = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                if key in seen:
                    continue
                if len(seen) >= _DIGESTS_HELD:
                    seen.clear()
                seen.add(key)
                own = Counter(digest(line) for line in text.split("\n") if line)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], ["text_key", "digest", "n"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, f"doc_id {id_type}, n_words long, digest string, text_key binary, n_notices long, notices string")
    rows = rows.join(F.broadcast(table) if few else table, "digest", "left")
    if not few:
        hits = texts.select("text").mapInArrow(each_line, "text_key binary, digest string, n long").join(table, "digest").dropDuplicates(["text_key", "digest"])
        hits = hits.groupBy("text_key").agg(F.sum("n").alias("many"), F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("names"))
        rows = rows.join(stored(hits, "notices"), "text_key", "left").withColumns({"n_notices": F.coalesce("many", F.lit(0).cast("long")), "notices": F.coalesce("names", F.lit(""))})
    return rows.select("doc_id", "n_words", "digest", "licence_id", "n_notices", "notices")


def scan_sql(known_rows) -> str:
    """scan over documents for (digest, licence_id) pairs."""
    bare = "regexp_replace(lower(@), '(?m)^[ \\t#*/;%-]*(?:" + _STATEMENT + "[^\\n]*|all rights reserved[ \\t.]*)$', '', 'g')"
    spaced = f"string_split(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
    spell = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    form = lambda c: f"array_to_string(list_transform(list_filter({spaced}, lambda w: w <> ''), lambda w: coalesce({spell}[w], w)), ' ')".replace("@", c)
    values = ", ".join(f"('{d}', '{name}')" for d, name in known_rows)
    return f"""
    with k(digest, licence_id) as (values {values}),
    d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
    f as (select r, doc_id, {form('text')} form from d),
    l as (select r, licence_id from (select r, sha256({form('line')}) digest from (select r, unnest(string_split(text, chr(10))) line from d) where line <> '') join k using (digest)),
    n as (select r, count(*) n, string_agg(distinct licence_id, ',' order by licence_id) names from l group by 1)
    select doc_id, case when form = '' then 0 else len(string_split(form, ' ')) end::bigint n_words, sha256(form) digest, licence_id, coalesce(n, 0)::bigint n_notices, coalesce(names, '') notices
    from f left join k on k.digest = sha256(form) left join n using (r)"""
