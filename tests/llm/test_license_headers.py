"""The license scan and its SQL agree on headers as they stand in source files."""

import duckdb
import pytest

from tidepool.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
WHOLE = "APACHE2-REF,APACHE2-COMPLY,APACHE2-COPY,APACHE2-URL,APACHE2-ASIS,APACHE2-SEE"


def marked(mark: str) -> str:
    return "\n".join((f"{mark} {line}").rstrip() for line in APACHE.splitlines())


TEXTS = {
    APACHE: (WHOLE, "Apache-2.0"),
    "SPDX-License-Identifier: MIT\n" + APACHE: ("SPDX:MIT," + WHOLE, "Apache-2.0,MIT"),
    f"/*\n{marked(' *')}\n */\nint main();\n": (WHOLE, "Apache-2.0"),
    marked("#"): (WHOLE, "Apache-2.0"),
    marked("  //"): (WHOLE, "Apache-2.0"),
    marked(";;"): (WHOLE, "Apache-2.0"),
    "GPL v. 2. See v.. License é v. 3 Év. x license v! now\x0b license? MIT License.\n\x0b\nMIT License": None,
    "": ("", ""),
}


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("licenses"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, sentence_ids, n_known, n_unknown, licenses FROM ({licenses.ORACLE}) ORDER BY doc_id").fetchall()
    got = licenses.op1_license_scans(spark, folder).select("doc_id", "sentence_ids", "n_known", "n_unknown", "licenses").orderBy("doc_id").collect()
    return want, [tuple(r) for r in got]


def test_sql_equals_operator_on_headers(both):
    want, got = both
    assert got == want


def test_commented_headers_are_read_whole(both):
    for expected, (_, ids, _, unknown, names) in zip(TEXTS.values(), both[1], strict=True):
        if expected:
            assert (ids, names) == expected and unknown == 0
