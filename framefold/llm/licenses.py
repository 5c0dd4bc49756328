"""Licence scans by canonical digests.

Texts are brought to a canonical form: lower case, copyright lines left out,
equivalent spellings made one, ASCII punctuation taken out, white space made
single spaces. The digest of an entire text is then joined by hash with the
digests of known licences, a constant table. Entire texts are a document as a
whole and each of its lines, where notices stand.

Defined cases: null and blank texts have no licence; equal rows are reported
alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The equivalent spellings that are made one.
SPELLINGS = {
    "licence": "license", "licenced": "licensed", "sub-license": "sublicense", "sub license": "sublicense", "non-commercial": "noncommercial", "non commercial": "noncommercial",
    "organisation": "organization", "favour": "favor", "honour": "honor", "modelled": "modeled", "per cent": "percent", "copyright holder": "copyright owner",
    "merchantability": "merchantibility", "http://": "https://", "gnu gpl": "gnu general public license", "©": "(c)", "–": "-", "—": "-", "“": "\"", "”": "\"", "’": "'",
}
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
COPYRIGHT = r"^\s*(copyright\b.*(\d{4}|\(c\)).*|\(c\)\s.*\d{4}.*)$"

#: The texts of known licences and notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: Notices of one line.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain."],
    "ARR": ["All rights reserved."],
}
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
LINK = "For more information, please refer to <https://unlicense.org>"


def whole_texts() -> list[tuple[str, str]]:
    """license, text of the licences of several lines: short ones with and without title, numbers and the line that reserves all rights; long ones as in license_texts."""
    out = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    titles = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"]}
    bodies = [(name, KNOWN[name]) for name in titles]
    for name, title, parts in (("BSD-2-Clause", "2-Clause", [SOURCE, BINARY]), ("BSD-3-Clause", "3-Clause", [SOURCE, BINARY, ENDORSE])):
        titles[name] = [f"BSD {title} License", f"The BSD {title} License", "BSD License", "The BSD License"]
        bodies += [(name, "\n".join([REDISTRIBUTION, *(f"{k}. {p}" if numbered else p for k, p in enumerate(parts, 1)), DISCLAIMER])) for numbered in (True, False)]
    for name, body in bodies:
        for reserved in ("", "All rights reserved.\n"):
            out += [(name, f"{title}\n{reserved}{body}") for title in ("", *titles[name])]
    out += [("Unlicense", f"{title}\n{UNLICENSE}\n{link}") for title in ("", "The Unlicense", "Unlicense") for link in ("", LINK, LINK.replace("https", "http"))]
    return out


#: The texts of several lines stand in the same table.
for _license, _text in whole_texts():
    NOTICES.setdefault(_license, []).append(_text)
PERMISSIVE = ["MIT", "ISC", "Apache-2.0", "CC-BY-4.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]


def canonical_line(line: Column) -> Column:
    """One line in canonical form; a copyright line becomes empty."""
    text = F.lower(line)
    text = F.when(text.rlike(COPYRIGHT), F.lit("")).otherwise(text)
    for spelling, one in SPELLINGS.items():
        text = F.replace(text, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(F.translate(text, PUNCTUATION, ""), r"\s+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a whole text, from its canonical lines."""
    lines = F.transform(F.split(text, r"\r?\n", -1), canonical_line)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known_digests(spark: SparkSession) -> DataFrame:
    """license, digest of every known text: a constant number of rows."""
    texts = [(k, v) for k, v in KNOWN.items()] + [(k, v) for k, vs in NOTICES.items() for v in vs]
    rows = spark.createDataFrame(texts, "license string, text string")
    return rows.select("license", digest(canonical("text")).alias("digest")).distinct()


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, license (of the whole text), licenses (of any entire text in it), n_notices, permissive of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce("text", F.lit("")), r"\r?\n", -1).alias("lines"))
    rows = rows.select("key", F.transform("lines", canonical_line).alias("lines"))
    lines = F.filter("lines", lambda x: x != "")
    units = rows.select("key", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(F.array_join(lines, " ")).alias("digest"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("digest"))))).alias("unit"))
    hits = units.select("key", "unit.whole", "unit.digest").join(F.broadcast(known_digests(spark)), "digest")
    # Equal rows share a key and its hits: counts are of one of them.
    found = hits.groupBy("key").agg(F.max(F.when(F.col("whole"), F.col("license"))).alias("license"), F.sort_array(F.collect_set("license")).alias("licenses"), F.sum((~F.col("whole")).cast("long")).alias("n_all"))
    every = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    copies = every.groupBy("key").agg(F.count("*").alias("copies"))
    found = found.join(copies, "key").withColumn("n_notices", (F.col("n_all") / F.col("copies")).cast("long")).drop("n_all", "copies")
    out = every.join(found, "key", "left")
    licenses = F.coalesce("licenses", F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", "license", licenses.alias("licenses"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.when(F.size(licenses) > 0, F.forall(licenses, lambda x: x.isin(PERMISSIVE))).alias("permissive"))
