from __future__ import annotations

import random
import re


from compare import SF
from marlstone.llm import licenses as L


def words(text):
    return [re.sub(r"[!-/:-@\[-`{-~]", "", w) for w in text.lower().split()]


def contained(text, template):
    """The largest share of a template's shingles in a window of the text."""
    w, m = words(text), words(template)
    k = min(5, len(m))
    own = {tuple(m[j : j + k]) for j in range(len(m) - k + 1)}
    step = max(1, len(m) // 4)
    size = step * -(-(len(m) - k + step) // step)
    found = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    return max((len({x for x in found[a : a + size] if x in own}) / len(own) for a in range(0, len(found), step)), default=0.0)


def test_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: {x.split(":")[0] for x in r["licenses"].split(",") if x} for r in L.op7_license_scan(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i] == {n for n, x in L.all_templates().items() if contained(t, x) >= L.CONTAINED}


def test_whole_licenses():
    """Copies of whole licences, among other words, edited to just above and below the threshold, against brute force; a text's matches do not depend on its neighbours."""
    templates, rng = L.whole_licenses(), random.Random(4)
    assert len(templates) >= 10 and sum(len(words(t)) > 200 for t in templates.values()) >= 6
    scanner, filler = L.Scanner(templates), [f"w{k}" for k in range(400)]
    texts, near = [], set()
    for name, text in templates.items():
        plain = text.split()
        # Words changed one by one lose five shingles each; enough of them are spread to come near the threshold from either side.
        for goal in (0.95, 0.82, 0.805, 0.795, 0.77):
            own, order = list(plain), list(range(0, len(plain), 6))
            rng.shuffle(order)
            while order and contained(" ".join(own), text) > goal:
                for _ in range(max(1, len(plain) // 300)):
                    own[order.pop()] = f"new{rng.random()}" if order else "new"
            share = contained(" ".join(own), text)
            near.add("above" if 0.8 <= share < 0.83 else "below" if 0.77 <= share < 0.8 else "")
            texts.append(" ".join(filler[: rng.randrange(300)] + own + filler[:50]))
    assert {"above", "below"} <= near
    got: dict[int, set[str]] = {}
    for t, name, *_ in scanner.scan(texts):
        got.setdefault(t, set()).add(name)
    for k, text in enumerate(texts):
        assert got.get(k, set()) == {n for n, x in templates.items() if contained(text, x) >= L.CONTAINED}, k
    alone = [(name, *rest) for t in texts[::7] for _, name, *rest in scanner.scan([t])]
    assert alone == [(name, *rest) for t, name, *rest in scanner.scan(texts) if t % 7 == 0]


def test_every_template_is_found_anywhere():
    scanner = L.Scanner()
    filler = " ".join(f"w{i}" for i in range(70))
    for name, text in L.TEMPLATES.items():
        for before in (0, 1, 7, 33):
            body = " ".join(filler.split()[:before]) + "\n" + text.upper() + "\n" + filler
            found = {n: (share, first) for _, n, share, first, _ in scanner.scan(["x y", body, filler])}
            assert found[name] == (1.0, before)
    changed = L.TEMPLATES["mit-grant"].replace("merge", "blend")
    assert any(n == "mit-grant" and 0.8 <= share < 1 for _, n, share, *_ in scanner.scan([changed]))
    assert scanner.scan([filler, ""]) == []


def test_bands_are_sure():
    scanner = L.Scanner()
    for n, (k, step, steps, bands) in scanner.plan.items():
        for _, own in scanner.classes[n]:
            j = len(own) * L.CONTAINED / (steps * step + len(own) * (1 - L.CONTAINED))
            assert steps * step >= n + step - k and (bands == 1 and n == k or 1 - (1 - j) ** bands >= L.SURE)


def test_odd_rows(odd, none):
    assert L.scan_licenses(odd).count() == odd.count()
    assert L.scan_licenses(none).count() == 0
