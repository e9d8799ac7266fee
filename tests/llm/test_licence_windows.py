"""Licence notices that are wrapped over lines, and SPDX tags."""

from __future__ import annotations

from ledgerweave.llm import licences

GPL = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation"
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"


def test_wrapped_notices_and_tags(spark):
    rows = [(1, GPL), (2, BSD), (3, "int x;\n//\n" + GPL + "\n\nplain"), (4, "# SPDX-License-Identifier: Apache-2.0"), (5, "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;"), (6, GPL.replace("\n", "\n\n")), (7, "he lost his driving license\n" + GPL)]
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1): "gpl", (1, 2): "gpl", (2, 0): "bsd", (2, 1): "bsd", (3, 3): "gpl", (3, 4): "gpl", (4, 0): "apache-2.0", (5, 0): "gpl", (6, 2): "unknown", (6, 4): "unknown", (7, 0): "unknown", (7, 2): "gpl", (7, 3): "gpl"}
