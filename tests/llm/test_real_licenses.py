from pathlib import Path

from pyspark.sql import functions as F

from maskwright.llm import licenses
from maskwright.llm.licenses import scan_licenses


def _gpl(name, version, who="program", mark=" * "):
    return "\n".join(mark + x for x in (
        "Copyright (C) 2011 Some Author", "", f"This {who} is free software; you can redistribute it and/or", f"modify it under the terms of the GNU {name}",
        "as published by the Free Software Foundation; either", f"version {version} of the License, or (at your option) any later version.", "",
        f"This {who} is distributed in the hope that it will be useful,", "but WITHOUT ANY WARRANTY; without even the implied warranty of",
    ))


BSD2 = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer."""
BSD3 = BSD2 + """
//
//    * Neither the name of Acme Inc. nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission."""
ISC = """# Permission to use, copy, modify, and distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies."""


def test_real_notices_and_whole_files(spark):
    heads = {
        "GPL-2.0": _gpl("General Public License", 2), "GPL-3.0": _gpl("General Public License", 3, mark="# "), "LGPL-2.1": _gpl("Lesser General Public License", "2.1", "library"),
        "LGPL-3.0": _gpl("Lesser General Public License", 3, "library"), "AGPL-3.0": _gpl("Affero General Public License", 3), "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "ISC": ISC,
    }
    rows = [(f"{k}/head.c", f"{v}\n\nint main() {{ return 0; }}") for k, v in heads.items()]
    folder = Path(licenses.__file__).parent / "license_texts"
    # a file as projects ship it: another holder above, and line breaks elsewhere
    for p in folder.glob("*.txt") if folder.exists() else ():
        rows += [(f"whole-{p.stem}/LICENSE", "Copyright (c) 1999-2020 Acme Widgets Ltd. and contributors.\n\n" + p.read_text().replace("  ", " ")), (f"whole-{p.stem}/src/x.c", "int x;")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, p string, text string")
    got = {r.path: r.license for r in scan_licenses(df, F.col("p")).collect()}
    assert {k: got[f"{k}/head.c"] for k in heads} == {k: k for k in heads}
    want = {path: path.split("/")[0].removeprefix("whole-") for path, _ in rows if path.startswith("whole-")}
    assert len(want) == 34 and {p: got[p] for p in want} == want
