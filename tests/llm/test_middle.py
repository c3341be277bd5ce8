"""op13 against a plain version, and the round trip of pieces."""

import hashlib
import re

import pytest
from hard import hard_rows
from same import assert_same, sql_rows

from coppice.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        units = UNIT.findall(text)
        n, d = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, n, form, *((None, None) if form == "plain" else (len(p), len(m))), sha(output), sha(text)))
    return out


def docs(n=200):
    kinds = ["one two  three\n\nfour", " lead and trail \n", "<", "<P", "S> <M", "a<P>b", "naïve 日本語 \U0001f600 é", "\t\t", "x", "<S", "\x0b\x0c y \x1c z\x85 w"]
    return [(i, kinds[i % len(kinds)] * (i % 4 + 1)) for i in range(n)] + [(i, "word " * 30_000 + "<") for i in range(300, 308)] + [(i, "x" * 200_000 + " y") for i in range(400, 404)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_plain(spark):
    rows = docs()
    assert {r[2] for r in plain(rows)} == {"plain", "spm", "psm"}
    assert got(fm.fill_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == sorted(plain(rows), key=str)


def test_hard_rows(hard, none):
    rows = [r[:2] for r in hard_rows()]
    assert got(fm.fill_middle(hard)) == sorted(plain(rows), key=str)
    assert fm.fill_middle(none).collect() == []


def test_reserved_names(spark):
    rows = [(i, f"some words here {i}", "a", 1, 2) for i in range(20)]
    named = spark.createDataFrame(rows, "doc_id long, text string, coppice_row string, place int, h1 int")
    assert got(fm.fill_middle(named)) == sorted(plain([r[:2] for r in rows]), key=str)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_sections(step):
    """However the output is cut into pieces, the marks are found."""
    for order in ("<S>suf <<P>pre<S<M>mid>P", "<P><S><M>", "<P>a<S>b<<M>c<"):
        sections, found = fm.Sections(), {}
        pieces = [order[i : i + step] for i in range(0, len(order), step)]
        for i, piece in enumerate([*pieces, ""]):
            for section, _, part in sections.feed(piece, last=i == len(pieces)):
                found[section] = found.get(section, "") + part
        want = dict(zip(re.findall("<[PSM]>", order), re.split("<[PSM]>", order)[1:], strict=True))
        assert found == {k: v for k, v in want.items() if v}


def test_assembled_pieces(spark):
    """The pieces of a document, in order, are its output."""
    rows = docs(60)
    made = fm.assembled(fm.with_forms(spark.createDataFrame(rows, "doc_id long, text string")))
    outputs = {}
    for r in made.collect():
        outputs[r._row] = outputs.get(r._row, "") + (r.piece or "")
    assert sorted(hashlib.sha256(x.encode()).hexdigest() for x in outputs.values()) == sorted(r[5] for r in plain(rows) if r[2] != "plain")


def test_sql(spark, sf_dir):
    fix = lambda f: f.assign(**{c: f[c].astype("Int64") for c in ("prefix_chars", "middle_chars")})
    assert_same(fix(fm.query(spark, sf_dir).toPandas()), fix(sql_rows(sf_dir, fm.SQL)))
