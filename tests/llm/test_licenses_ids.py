import os
import textwrap

import pytest

from ledgerloom.llm import licenses


def test_rows_of_one_id_show_one_merged_result(spark, make_docs):
    docs = make_docs([(1, licenses.KNOWN["MIT"]), (1, "no licence\nAll rights reserved."), (None, "Licensed under CC BY 4.0."), (None, "x"), (2, "x")])
    found = licenses.scan(docs, licenses.known_digests(spark)).collect()
    want = [(1, "MIT", "Reserved")] * 2 + [(None, "CC-BY-4.0 notice", "CC-BY-4.0 notice")] * 2 + [(2, None, "")]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_published_wrappings_are_found(spark, make_docs, sign):
    rows, want = [], {}
    for name, titles in licenses.HEADINGS.items():
        for title in ("", *titles):
            for rights in ("", "All rights reserved."):
                for width in (64, 79, 300):
                    head = [title, "", "Copyright (c) 2019-2021 Jane Doe <jane@example.org>", "Copyright 2022, Doe Ltd.", rights, ""]
                    lines = [*head, *textwrap.wrap(licenses.KNOWN[name], width)]
                    want[len(rows)] = {name}
                    # A bare "BSD License" stands above either text of that family, each with its own digest.
                    rows.append((len(rows), "\n".join(sign + x for x in lines)))
    found = {r["doc_id"]: r["license"] for r in licenses.scan(make_docs(rows), licenses.known_digests(spark)).collect()}
    assert all(found[i] in names for i, names in want.items()) and len(want) > 100


def test_lines_of_a_body_that_begin_with_copyright_stay(spark, make_docs):
    text = licenses.KNOWN["ISC"].replace("the above copyright notice", "the above\ncopyright notice")
    near = licenses.KNOWN["ISC"].replace("copyright notice", "")
    rows = [(1, text), (2, near), (3, "(c) 2020 A\n© B\ncopyright (C) C\nCopyright [yyyy] [name]\n" + text), (4, "(c) you must retain\n" + text)]
    found = {r["doc_id"]: r["license"] for r in licenses.scan(make_docs(rows), licenses.known_digests(spark)).collect()}
    assert found == {1: "ISC", 2: None, 3: "ISC", 4: None}


def test_long_texts_are_found_by_their_digests(spark, make_docs):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    folder = "/usr/share/common-licenses"
    rows = [(k, open(f"{folder}/{f}").read()) for k, f in enumerate(files.values()) if os.path.exists(f"{folder}/{f}")]
    if not rows:
        pytest.skip("no licence texts on this machine")
    rows = [(k, t.upper().replace("HTTPS", "http").replace("\n", " \r\n  ")) for k, t in rows]
    found = {r["doc_id"]: r["license"] for r in licenses.scan(make_docs(rows), licenses.known_digests(spark)).collect()}
    names = list(files)
    assert found == {k: names[k] for k, _ in rows}
