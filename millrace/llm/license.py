"""Licence scan by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form: lower case, copyright lines removed, punctuation and white space runs made one
space, equivalent spellings made one.  The SHA-256 of the whole form is joined to those of known licences; the known
side is a fixed list, so its broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "copyright" before one of these words speaks of the right, not of its holder; a mark after it keeps its line.
KEPT = (
    r"((?i:copyright))([^\p{L}\p{N}\n]*(?:(?i:notices?|holders?|owners?|licen[cs]es?|laws?|interests?|statements?|protection|permission|disclaimer)"
    r"|THE|AND|OR|IN|OF|TO|IS|AS|ON|FOR)(?:[^\p{L}\p{N}]|\z))"
)
#: A whole line of a copyright notice: a year, a sign, a placeholder or a name follows the word, so that a wrapped sentence
#: ("copyright notice and this ...", "(c) You must ...") stays.  For texts in their own case, after KEPT; lines end at \n.
NOTICE_LINE = (
    r"^[^\p{L}\p{N}\n]*(?:(?i:copyright)[^\p{L}\p{N}\n\x02]+(?:\p{N}|(?i:\(c\))|©|[\[<{]|(?i:by|c)[^\p{L}\p{N}\n]|\p{Lu})"
    r"|(?i:\(c\))[^\n]*(?:\p{N}{4}|(?i:copyright)(?:[^\p{L}\p{N}\n\x02]|$))|©|(?i:all rights reserved))[^\n]*$"
)
#: Equivalent spellings, each as whole words of a canonical form.
EQUIVALENT = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("acknowledgement", "acknowledgment"),
    ("http", "https"),
]

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Public licence texts and the short notices that stand for them.
KNOWN = [
    ("MIT", "MIT License\n\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n\n" + _PERMISSION),
    ("MIT", _PERMISSION),
    ("MIT", "Released under the MIT License."),
    ("ISC", "ISC License\n\n" + _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _NO_WARRANTY),
    ("ISC", _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _NO_WARRANTY),
    ("0BSD", _USE + ".\n\n" + _NO_WARRANTY),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Further whole texts.
MORE = [("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>")]
#: Digests of the canonical forms of the whole texts in /usr/share/common-licenses, and of each up to "END OF TERMS AND CONDITIONS".
FULL = [
    ("Apache-2.0", "ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c"),
    ("Apache-2.0", "ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), KEPT, "$1\x02$2")
    c = F.lower(F.regexp_replace(c, "(?md)" + NOTICE_LINE, ""))
    c = F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in EQUIVALENT:
        # twice, since a match takes the space that a repeated word would need
        for _ in range(2 if " " not in a else 1):
            c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def known(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the fixed list; one row per digest."""
    listed = [(i, t, None) for i, t in KNOWN + MORE] + [(i, None, d) for i, d in FULL]
    rows = spark.createDataFrame(listed, "license_id string, license_text string, digest string")
    return rows.select("license_id", F.coalesce("digest", F.sha2(canonical(F.col("license_text")), 256)).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (null where the whole text is no known licence).

    Null texts, and texts of punctuation alone, have the digest of the empty string and match nothing.  Repeated rows
    give repeated rows, in any order; extra columns are not read.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"))
    match = F.broadcast(known(df.sparkSession))
    return rows.join(match, rows["canonical_sha256"] == match["digest"], "left").select("doc_id", "canonical_sha256", "license_id")


def canonical_sql(text: str) -> str:
    """canonical() as DuckDB SQL."""
    c = f"regexp_replace(coalesce({text}, ''), '{KEPT}', '\\1' || chr(2) || '\\2', 'g')"
    c = f"lower(regexp_replace({c}, '(?m){NOTICE_LINE}', '', 'g'))"
    c = f"' ' || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in EQUIVALENT:
        for _ in range(2 if " " not in a else 1):
            c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'))"


def scan_sql() -> str:
    """scan() as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN + MORE)
    digests = ", ".join(f"({quote(i)}, {quote(d)})" for i, d in FULL)
    return f"""WITH listed AS (SELECT license_id, sha256({canonical_sql("license_text")}) AS digest FROM (VALUES {texts}) AS k(license_id, license_text) UNION ALL VALUES {digests}),
known AS (SELECT min(license_id) AS license_id, digest FROM listed GROUP BY digest),
d AS (SELECT doc_id, sha256({canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN known ON digest = canonical_sha256"""
