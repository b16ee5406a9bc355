from hazecast.llm import licenses
from hazecast.llm.license_texts import KNOWN, MIT
from llm_helpers import documents, hard_rows


def test_spellings_case_and_copyright_lines(spark):
    changed = MIT.upper().replace("COPYRIGHT (C) <YEAR> <COPYRIGHT HOLDERS>",
                                  "Copyright © 1999-2003, Somebody Else\n(c) 2004 Another One\nAll rights reserved.")
    changed = changed.replace("SUBLICENSE", "sub-licence").replace('"AS IS"', "“as is”").replace("\n", "\r\n  * ")
    rows = [(1, MIT, "en", "a"), (2, changed, "en", "a"), (3, MIT + " And more.", "en", "a"),
            (4, "released under the mit licence", "en", "a")]
    got = {r.doc_id: r.license for r in licenses.scanned(documents(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: "MIT"}


def test_every_known_text_is_found(spark):
    rows = [(i, text.lower(), "en", "a") for i, (_, text) in enumerate(KNOWN)]
    got = {r.doc_id: r.license for r in licenses.scanned(documents(spark, rows)).collect()}
    assert got == {i: name for i, (name, _) in enumerate(KNOWN)}


def test_whole_texts_of_long_licenses(spark):
    """Each from its title on to its end, in other line breaks; a notice inside a text is no match."""
    names = {"Apache-2.0", "GPL-1.0-only", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only",
             "LGPL-3.0-only", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.2-only", "GFDL-1.3-only", "Artistic-1.0-Perl"}
    whole = {name: max((t for n, t in KNOWN if n == name), key=len) for name in sorted(names & {n for n, _ in KNOWN})}
    assert {*whole} == names and all(len(t) > 5000 for t in whole.values())
    rows = [(i, "\r\n".join(t.split("\n")), "en", "a") for i, t in enumerate(whole.values())]
    rows.append((99, "A program.\nLicensed under the Apache License, Version 2.0.", "en", "a"))
    got = {r.doc_id: r.license for r in licenses.scanned(documents(spark, rows)).collect()}
    assert got == {**dict(enumerate(whole)), 99: None}


def test_hard_rows_and_ties(spark):
    rows = hard_rows()
    got = licenses.scanned(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.license is None for r in got)
    known = spark.createDataFrame([("b", got[0].digest), ("a", got[0].digest), (None, None)],
                                  "license string, digest string")
    again = licenses.scanned(documents(spark, rows), known)
    assert {r.license for r in again.filter(f"digest = '{got[0].digest}'").collect()} == {"a"}
    assert licenses.scanned(documents(spark, [])).count() == 0


def test_letters_beyond_ascii_stay(spark):
    rows = [(1, "älter", "de", "a"), (2, "lter", "de", "a"), (3, "  ÄLTER!".replace("Ä", "ä"), "de", "a")]
    got = {r.doc_id: r.digest for r in licenses.scanned(documents(spark, rows)).collect()}
    assert got[1] != got[2] and got[1] == got[3]
