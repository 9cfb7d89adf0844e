"""Licence texts by canonical digest lookup.

A text is put into canonical form (case, copyright lines, punctuation and
equivalent spellings normalised), digested, and hash-joined to the digests of
known licences. The entire text of a document is looked up, and so is each of
its lines, always as a whole, so that notices inside a document are found.

The known licences are given as texts where they are short and as digests of
their canonical form where they are long (``DIGESTS``: Apache, Artistic, BSD,
CC0, GFDL, GPL, LGPL and MPL, with and without what follows their terms).

Defined results: null and empty texts have the digest of the empty text and no
licence, and empty lines none; repeated rows are looked up alone; other columns
are not read; a text or line equal to several known texts gets the least name.
The known table is broadcast if it has at most ``SMALL`` rows, else joined by a
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SMALL = 100_000  # digests of 32 letters: below 10 MB

# Equivalent spellings, after lower-casing (long form, short form).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
]

# Notices and texts of widely used licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = [
    ("BSD-2-Clause", _BSD2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2 + _BSD_END),
    ("BSD-3-Clause", _BSD2 + _BSD3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD2 + _BSD3 + _BSD_END),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License\n\n" + _0BSD),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "The ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

# Digests of the canonical form of long texts.
DIGESTS = [
    ("Apache-2.0", "bb90ddb921a4bcfa8bbc590c5f5577e2"),
    ("Apache-2.0", "d2379ad9b4d79a35efe84fb555e4c1a5"),
    ("Apache-2.0", "cf1428c70cf80d21fa8ceb3b4980a78a"),
    ("Artistic-1.0-Perl", "16ce2a0e3a36daef45584aa03b283555"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "d38eefea768c29c8c31809db4764b7e4"),
    ("GFDL-1.3", "6d6d89faf0cf083cb10217aeaed450e5"),
    ("GPL-1.0", "b37a688f44419d3168b23775b65749eb"),
    ("GPL-1.0", "42c3900f3df27526919a45781fcfaa40"),
    ("GPL-1.0", "144621ef5a09b5f767fa0f7461f93009"),
    ("GPL-2.0", "707992d5752580ab5b883e8a7baf875a"),
    ("GPL-2.0", "96bbcedd17caa6bb54973887a5e6279e"),
    ("GPL-2.0", "732f276f4d89d7654a879370d8c0f96d"),
    ("GPL-3.0", "f64797b28d40d59d82ee3ff9013adebb"),
    ("GPL-3.0", "f916e146ccd175212bfe5a785494f1b0"),
    ("GPL-3.0", "e5510f7f9ba4ee8b054772b5fe8a6a7a"),
    ("LGPL-2.0", "49c35a2f80e5ce15f8ab7230f3eb4dc2"),
    ("LGPL-2.0", "df6e052665f12c6b0a3ef166c66a3609"),
    ("LGPL-2.0", "2b8b57a7944cf63903372fc85b2db840"),
    ("LGPL-2.1", "f3e4b8b3f89fd84b83748e4530f560c1"),
    ("LGPL-2.1", "55be839e8b53e121ad69f91220eabaad"),
    ("LGPL-2.1", "9603080d682a765016a42fbd7f2ff8d3"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "b7edc06df79bc44a04f12befb8111960"),
    ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2"),
]

COPYRIGHT = r"(?m)^[ \t]*(copyright|©|\(c\)|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: F.Column) -> F.Column:
    """Canonical form of a text column (null: empty)."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT, " ")
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, out)


def digest(text: F.Column) -> F.Column:
    return F.md5(F.encode(canonical(text), "UTF-8"))


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of the known texts, and of DIGESTS unless texts are given."""
    rows = spark.createDataFrame(KNOWN if texts is None else texts, "licence string, text string").select("licence", digest(F.col("text")).alias("digest"))
    if texts is None:
        rows = rows.unionByName(spark.createDataFrame(DIGESTS, "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, text_digest, text_licence, line_licences, n_license_lines) of each row.

    ``line_licences`` are the distinct names found in lines, in order, joined
    by commas (empty: none). Texts are not shuffled: rows go on with their
    digests only, written once with the number of the row.
    """
    spark = docs.sparkSession
    table = common.sized(known(spark, texts), SMALL)
    full = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x != "")
    d = common.with_row(docs.select(F.col(key).alias("key"), digest(F.col(text)).alias("text_digest"), F.transform(full, lambda x: F.unhex(digest(x))).alias("lines")))
    whole = d.select(common.ROW, "key", "text_digest").join(table.toDF("text_digest", "text_licence"), "text_digest", "left")
    lines = d.select(common.ROW, F.explode("lines").alias("__line"))
    noted = lines.join(table.select(F.unhex("digest").alias("__line"), "licence"), "__line")
    noted = noted.groupBy(common.ROW).agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"), F.count("*").alias("n_license_lines"))
    return whole.join(noted, common.ROW, "left").select(F.col("key").alias(key), "text_digest", "text_licence", F.coalesce("line_licences", F.lit("")).alias("line_licences"), F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"))
