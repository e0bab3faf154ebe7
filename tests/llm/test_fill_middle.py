import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.llm import fill_middle as fim

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def units_of(text, unit):
    return LINES.findall(text) if unit == "line" else list(text)


def brute(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = units_of(text, unit)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_units_at_every_place(unit):
    draw = random.Random(1)
    for _ in range(150):
        texts = ["".join(draw.choice("ab\n\nñ日𝄞") for _ in range(draw.choice([0, 1, 7, 8, 9, 40]))) for _ in range(draw.randrange(1, 8))]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        found = fim.Units(offsets, np.frombuffer(b"".join(raw), np.uint8), unit)
        wanted = [units_of(t, unit) for t in texts]
        assert found.counts.tolist() == list(map(len, wanted))
        for k in range(int(found.counts.max()) + 1):
            at = found.cut(np.minimum(k, found.counts))
            assert (at - offsets[:-1]).tolist() == [len("".join(w[:k]).encode()) for w in wanted]
            assert found.chars_between(offsets[:-1], at).tolist() == [len("".join(w[:k])) for w in wanted]


ROWS = [
    (1, None), (2, ""), (3, "one line"), (4, "a\n"), (5, "\n\n\n"), (6, "x\ny\n\nz"), (7, "has <S> inside\nand more"), (8, "日本\nñ\r\n𝄞 end"),
    (9, "line\n" * 30_000), (None, "no id\nat all"), (10, "same\ntext\nhere"), (10, "same\ntext\nhere"), (11, "<\nP>\nS>\n<M"), (12, "w" * 200_000),
]


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 0)])
def test_equals_brute_force_and_restores(make_docs, with_clashes, unit, rate, spm_rate):
    rows = ROWS + [(100 + i, f"t{i}\n\nline {i}\nlast") for i in range(60)]
    docs = with_clashes(make_docs(rows)).withColumn("fim_form", F.lit("old"))
    made = fim.fill_middle(docs, unit=unit, rate=rate, spm_rate=spm_rate)
    assert made.columns == [c for c in docs.columns if c != "fim_form"] + list(fim.FIELDS)
    back = made.withColumn("back", fim.restore_fim(F.col("fim_output"), F.col("fim_form"))).collect()
    got = sorted((str(r.doc_id), r.text or "", r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) for r in back)
    assert got == sorted((str(i), t or "", *brute(i, t, unit, rate, spm_rate)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in back)
    assert {r.fim_form for r in back} == ({"plain", "psm", "spm"} if spm_rate else {"plain", "psm"})


def test_empty_table_and_markers(make_docs):
    assert fim.fill_middle(make_docs([])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "P", "<M>"), ("ab", "ba", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fim.fill_middle(make_docs([]), markers=bad)
    with pytest.raises(ValueError):
        fim.fill_middle(make_docs([]), unit="page")
