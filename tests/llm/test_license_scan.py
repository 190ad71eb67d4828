import re

from pyspark.sql import functions as F

from tailorspark.llm import license_scan
from util import rows

FILES = "repo string, path string, text string"


def run(spark, data, **more):
    return license_scan.scan(spark.createDataFrame(data, FILES), **more)


def test_headers_files_and_inheritance(spark):
    data = [("r", "LICENSE", "Released under the MIT License."), ("r", "a.py", "# x\ncode"),
            ("r", "sub/COPYING.txt", "Licensed under the Apache License, Version 2.0."), ("r", "sub/deep/x/b.py", "code"),
            ("r", "sub/c.py", "// This work is licensed under the GNU General Public License, version 3.\ncode"),
            ("q", "a.py", "code"), ("q", "d/NOTICE", "some long prose about nothing that has a license word in it"),
            ("q", "d/a.py", None), (None, None, None), (None, "LICENSE.md", "SPDX-License-Identifier: MIT")]
    got = rows(run(spark, data), "repo", "path", "own_license", "inherited_license", "inherited_from", "license")
    assert got == [
        (None, None, None, "MIT", "", "MIT"), (None, "LICENSE.md", "MIT", "MIT", "", "MIT"),
        ("q", "a.py", None, None, None, None), ("q", "d/NOTICE", None, None, None, None), ("q", "d/a.py", None, None, None, None),
        ("r", "LICENSE", "MIT", "MIT", "", "MIT"), ("r", "a.py", None, "MIT", "", "MIT"),
        ("r", "sub/COPYING.txt", "Apache-2.0", "Apache-2.0", "sub", "Apache-2.0"),
        ("r", "sub/c.py", "GPL-3.0", "Apache-2.0", "sub", "GPL-3.0"),
        ("r", "sub/deep/x/b.py", None, "Apache-2.0", "sub", "Apache-2.0")]


def test_two_licences_in_a_directory_and_repeated_rows(spark):
    data = [("r", "LICENSE-MIT", "Released under the MIT License."), ("r", "LICENSE-APACHE", "Apache License, Version 2.0"),
            ("r", "x", "code"), ("r", "x", "code")]
    assert rows(run(spark, data).where("path = 'x'"), "license") == [("Apache-2.0 AND MIT",)] * 2


def test_every_template_finds_itself(spark):
    cued = [(str(i), name, text) for i, (name, text) in enumerate(license_scan.TEMPLATES) if re.search(license_scan.CUE, text)]
    got = {r["repo"]: r["own_license"] for r in run(spark, [(i, "f", "start\n" + text) for i, _, text in cued]).collect()}
    assert got == {i: name for i, name, _ in cued} and len(cued) > 20


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []).count() == 0
    files = spark.createDataFrame([("r", "a", "Released under the MIT License.")], FILES).withColumns(
        {"license": F.lit(1), "notice": F.lit(2), "term": F.lit(3)})
    r = license_scan.scan(files).first()
    assert (r["license"], r["notice"], r["term"]) == ("MIT", 2, 3)


def test_long_text(spark):
    text = "word " * 100_000 + "\nReleased under the MIT License."
    assert run(spark, [("r", "a", text), ("r", "LICENSE", text)]).select("own_license").distinct().first()[0] == "MIT"


def test_bodies_headers_and_all_rights_reserved(spark):
    import textwrap
    body = {name: text for name, text in license_scan.BODIES if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")}
    files = {name: "Copyright (c) 2020, Acme Corp. All rights reserved.\n\n" + textwrap.fill(text, 72) for name, text in body.items()}
    header = ["This program is free software: you can redistribute it and/or modify",
              "it under the terms of the GNU General Public License as published by",
              "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    data = [(n, "LICENSE", t) for n, t in files.items()] + [(n, "a.py", "code") for n in files] + [
        ("x", "plain.c", "\n".join(["int a;", "", *header, "", "int b;"])),
        ("x", "comment.py", "\n".join([*("# " + h for h in header), "import os"])),
        ("x", "mit.py", "\n".join(["# Copyright 2020 A", "#", *("# " + h for h in textwrap.wrap(body["MIT"], 70)), "import os"])),
        ("x", "own.py", "# Copyright. All rights reserved.\ncode")]
    got = {(r["repo"], r["path"]): r["license"] for r in run(spark, data).collect()}
    assert got == {(n, p): n for n in files for p in ("LICENSE", "a.py")} | {
        ("x", "plain.c"): "GPL-3.0", ("x", "comment.py"): "GPL-3.0", ("x", "mit.py"): "MIT", ("x", "own.py"): "Proprietary"}


def test_denied_licences_name_none(spark):
    denied = ["This file is not released under the MIT License.", "# These files are no longer licensed under the Apache License, Version 2.0",
              "It was never publicly distributed under the GNU General Public License, version 3."]
    data = [("r", str(i), "code\n" + t) for i, t in enumerate(denied)] + [("r", "3", f"{denied[0]}\nReleased under the MIT License.")] + [
        ("q", "LICENSE", denied[0]), ("q", "4", "code"), ("p", "5", "Not sold here.\n\nReleased under the MIT License.")]
    got = {r["path"]: r["license"] for r in run(spark, data).collect()}
    assert got == {"0": None, "1": None, "2": None, "3": "MIT", "LICENSE": None, "4": None, "5": "MIT"}
