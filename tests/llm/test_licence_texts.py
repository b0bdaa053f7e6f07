"""Whole licence texts are known, wrapped or not, with their notices."""

import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")
from tessera.llm import licence_texts, licences  # noqa: E402

FILES = "/usr/share/common-licenses/"
SCHEMA = "doc_id long, text string"


def found(spark, texts):
    rows = licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return [r.licence for r in sorted(rows, key=lambda r: r.doc_id)]


def wrap(t, width):
    return "\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n"))


def test_wrapped_and_unwrapped(spark):
    own = {"MIT": licences._MIT, "ISC": licences._ISC, "BSD-2-Clause": licences._BSD2, "BSD-3-Clause": licence_texts._BSD3, "Unlicense": licence_texts._UNLICENSE}
    texts = [(n, f"{head}{wrap(t, w)}\n") for n, t in own.items() for w in (60, 66, 70, 74, 79, 99999) for head in ("", "Copyright (c) 2020 Someone\n\n", "Copyright Acme Inc.\n\n", "© 2021 Someone\n\n")]
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n" + licences._ISC.split("\n\n")[1]
    texts.append(("ISC", isc))
    assert found(spark, [t for _, t in texts]) == [n for n, _ in texts]


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence files here")
def test_published_files(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    whole = [open(FILES + f, encoding="utf-8").read() for f in names]
    assert found(spark, whole + [re.sub(r"(?<!\n)\n(?!\n)", " ", t) for t in whole]) == [*names.values()] * 2


def test_only_notices_are_taken_out(spark):
    lines = ["Copyright (C) 1989, 1991 Someone", "copyright 2020 x", "(c) 2020 x", "© x", "Copyright [yyyy] [name]", "Copyright: x", "Copyright Acme Inc.", "copyright notice and this", "copyright holder, and you", "copyrighted by the", "(c) You must retain", "copyright"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    kept = {r.i for r in df.select("i", licences.canonical(F.col("t")).alias("c")).collect() if r.c.strip()}
    assert kept == {7, 8, 9, 10, 11}
