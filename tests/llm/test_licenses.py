import os
import textwrap

from pyspark.sql import functions as F

from tessella.llm import licenses

MIT = licenses.KNOWN[13][1]


def test_normalisation_joins_equal_texts_only(spark):
    rows = [
        (1, "some prose\n  LICENCED under the  apache licence, version 2.0!\nmore"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0. And more"),
        (5, "Copyright (c) 2020 A. Person\n" + MIT.upper().replace(". ", ".\n")), (6, "** Released under the MIT License"), (6, "Released under the MIT Licence."), (7, "x " * 50_000),
        (8, "© 2021 X\n(c) Y\nReleased under the MIT License.\nAll rights reserved."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = {(r.doc_id, r.license_id, r.n_lines + r.n_blocks, r.whole_text) for r in licenses.scan(df).collect()}
    assert got == {(1, "Apache-2.0", 1, False), (5, "MIT", 0, True), (6, "MIT", 2, False), (8, "MIT", 1, True)}
    assert licenses.scan(df.limit(0)).count() == 0


def test_published_forms_blocks_and_comments(spark):
    texts = {i: t for i, t in licenses.KNOWN if len(t) >= licenses.BODY}
    wrapped = {i: textwrap.fill(t, 76) for i, t in texts.items()}
    header = "".join(f"# {line}\n" for line in wrapped["Apache-2.0"].splitlines())
    two = wrapped["MIT"].replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    commented = "/*\n" + "".join(f" * {line}\n" for line in two.splitlines()) + " */\nint main;\n"
    rows = [
        (1, "MIT License\n\nCopyright (c) 2024 A. Person\n\n" + two), (2, "BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n" + wrapped["BSD-3-Clause"]),
        (3, "ISC License\n\nCopyright 1999 Y\n\n" + wrapped["ISC"]), (4, wrapped["Unlicense"]), (5, "#!/bin/sh\n" + "set -e\n\n" + header + "\necho done\n"), (6, commented),
        (7, "x\n\n" + wrapped["Zlib"] + "\n\ny"), (8, "This program is a song.\nThe end."),
    ]
    if os.path.exists("/usr/share/common-licenses/Apache-2.0"):
        rows += [(20 + k, open(f"/usr/share/common-licenses/{n}", encoding="utf8").read()) for k, n in enumerate(("Apache-2.0", "GPL-3", "MPL-2.0", "LGPL-2.1"))]
    got = {(r.doc_id, r.license_id, r.n_blocks, r.whole_text) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(1, "MIT", 0, True), (2, "BSD-3-Clause", 1, True), (3, "ISC", 1, True), (4, "Unlicense", 0, True), (5, "Apache-2.0", 1, False), (6, "MIT", 1, False), (7, "Zlib", 1, False)}
    if len(rows) > 8:
        want |= {(20, "Apache-2.0", 0, True), (21, "GPL-3.0", 0, True), (22, "MPL-2.0", 1, True), (23, "LGPL-2.1", 0, True)}
    assert want <= got and {r for r in got if r[0] == 8} == set()
