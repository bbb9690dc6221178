"""Licence scan by canonical digest, in built-in functions only.

A text is lower-cased; lines that state a copyright are dropped; whatever is neither a letter nor a digit becomes a
gap between words; equivalent spellings become one. The SHA-256 of the whole canonical text is then hash-joined to
the digests of known licences, which go through the same expression.

Null texts count as empty. The digest of a text without words is that of the empty canonical text and matches no
licence. Repeated rows stay repeated; an empty table gives no rows. The known table is a fixed list, so it is
broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as one; both sides are canonical words, with two blanks between words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub  license", "sublicense"), ("sub  licensed", "sublicensed"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorised", "authorized"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("copyright  owner", "copyright  holder"), ("copyright  owners", "copyright  holders"), ("non  infringement", "noninfringement"), ("whilst", "while"), ("per  cent", "percent"),
)

COPYRIGHT_LINE = r"\n[^\n\p{L}\p{N}]*(copyright[ \t]*(\(c\)|©|[0-9]|:|<|\[)|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*"
GAP = r"[^\p{L}\p{N}]+"

# The texts of public licences; those in the folder are whole, as Debian ships them.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
KNOWN = {
    "MIT": f'MIT License\n\nCopyright (c) 2000 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}',
    "ISC": f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_AS_IS}",
    "BSD-2-Clause": f"{_BSD_TWO}\n{_BSD_AS_IS}",
    "BSD-3-Clause": f"{_BSD_TWO}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_AS_IS}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-mention": "Licensed under the Apache License, Version 2.0.",
} | {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))}


def canonical(text: Column) -> Column:
    """Canonical words, each between blanks of its own."""
    t = F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.concat(F.lit("  "), F.regexp_replace(t, GAP, "  "), F.lit("  "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of a fixed list of texts."""
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("t")) for k, v in (texts or KNOWN).items()])
    return spark.range(1).select(F.inline(rows)).select("license_id", F.sha2(canonical(F.col("t")), 256).alias("digest"))


def match(df: DataFrame, id_col: str, text_col: str, texts: dict[str, str] | None = None) -> DataFrame:
    """(``id_col``, digest, license_id): one row per row of ``df``; license_id is null where the text is no known licence."""
    own = df.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return own.join(F.broadcast(known_licenses(df.sparkSession, texts)), "digest", "left").select(id_col, "digest", "license_id")


def oracle_sql(table: str = "documents") -> str:
    """The same in DuckDB."""

    def canon(text: str) -> str:
        t = f"lower(coalesce({text}, ''))"
        t = f"regexp_replace(chr(10) || {t}, '{COPYRIGHT_LINE}', '', 'g')"
        t = f"'  ' || regexp_replace({t}, '{GAP}', '  ', 'g') || '  '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"sha256(trim({t}))"

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    return f"""WITH known AS (SELECT license_id, {canon("t")} AS digest FROM (VALUES {values}) AS v(license_id, t)),
        own AS (SELECT doc_id, {canon("text")} AS digest FROM {table})
        SELECT doc_id, own.digest, license_id FROM own LEFT JOIN known ON own.digest = known.digest"""
