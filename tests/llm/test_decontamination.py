"""Decontamination against a plain version of its definition, on both ways of joining."""

from __future__ import annotations

import random
import re

import pytest

from quern.llm import decontaminate as dec

WORD = re.compile("[^\x20\x09-\x0d]+")
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
UNITS = set(dec.UNITS.split())


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def templates(text):
    """(token, is a slot, value) of each word."""
    out, last = [], None
    for m in WORD.finditer(text or ""):
        word = m[0].strip(MARKS) or m[0]
        bare = not m[0].strip(MARKS)
        value = low(word)
        number = not bare and all(c in "0123456789.,/:+-%^" for c in word) and any(c.isdigit() and c.isascii() for c in word)
        unit = value in UNITS and last is not None and last[3]
        opens = last is None or last[4] in ".!?:"
        newline = m.start() > 0 and text[m.start() - 1] == "\n"
        upper = "A" <= word[0] <= "Z" or "À" <= word[0] <= "Ý"
        name = upper and not opens and not newline and not number and not unit
        kind = "#number" if number else "#name" if name else "#unit" if unit else value
        last = (kind, number or name or unit, value, number, m[0][-1])
        out.append(last)
    return out


def want(docs, items, window=8, literal=5, coverage=0.5):
    out = []
    for text in docs:
        d, found = templates(text), []
        for ident, item in sorted(set(items), key=str):
            t = templates(item)
            s = min(window, len(t))
            hits = {}
            for a in range(len(t) - s + 1 if s else 0):
                w = t[a : a + s]
                exact = sum(not x[1] for x in w) < min(literal, s)
                for p in range(len(d) - s + 1):
                    v = d[p : p + s]
                    if exact:
                        good = [x[2] for x in w] == [x[2] for x in v]
                    else:
                        good = [x[0] for x in w] == [x[0] for x in v]
                    if good:
                        hits.setdefault(p - a, []).append((p, a))
            best = (0.0, False)
            for g in sorted(hits):
                there, back, covered, done, changed = {}, {}, 0, 0, False
                for p, a in sorted(hits[g], key=lambda x: x[1]):
                    pairs = [(t[k][2], d[g + k][2]) for k in range(a, a + s) if t[k][1]]
                    both = {**there}
                    if any(both.setdefault(x, y) != y for x, y in pairs) or len(set(both.values())) < len(both):
                        continue
                    for x, y in pairs:
                        there[x], back[y] = y, x
                        changed |= x != y
                    covered += a + s - max(a, done)
                    done = a + s
                if covered / len(t) > best[0]:
                    best = covered / len(t), changed
            if best[0] >= coverage:
                found.append((ident, round(best[0], 9), best[1]))
        out.append(sorted(found, key=str))
    return out


def rows():
    rng = random.Random(5)
    plain = "how many does the old buy if each of them costs more than what was paid last year for a box and then sells half to her friend in town".split()
    items = []
    for k in range(14):
        w = [rng.choice(plain) for _ in range(rng.choice([3, 5, 7, 9, 14, 30]))]
        for _ in range(rng.randint(0, len(w) // 2)):
            w[rng.randrange(len(w))] = rng.choice(["3", "12.5", "Anna", "Rome,", "40 km", "7 dollars", "(Otto)", "1/2", "Élan"])
        items.append((k, " ".join(w).capitalize() + rng.choice("?.")))
    items += [(3, "A second text under the same number is judged apart from the first of them"), (3, "A second text under the same number is judged apart from the first of them"), (None, "Nobody has numbered this item but it is asked of every model that reads it"), (9007199254740993, "Large numbers of items stay what they are and are never made floating ones"), (20, None), (21, "")]
    docs = [None, "", " \n "]
    for _, t in items:
        if t:
            before, after = (" ".join(rng.choice(plain) for _ in range(rng.randint(0, 9))) for _ in range(2))
            other = re.sub(r"\b12\.5\b", "9", re.sub(r"\b3\b", "8", t)).replace("Anna", "Emma").replace("Otto", "Anna")
            docs += [f"{before} {t} {after}", f"{before}.\n{other} {after}", t.lower(), f"{t} {other}", " ".join(t.split()[: max(2, len(t.split()) // 2)])]
    docs += [docs[5]] * 3 + ["word " * 60_000 + items[0][1]]
    return docs, items


@pytest.mark.parametrize("most", [2_000_000, -1])
def test_against_the_definition(spark, most):
    docs, items = rows()
    frame = spark.createDataFrame([(i, t, "x", 1, "r", "k") for i, t in enumerate(docs)], "doc_id long, text string, item_id string, h int, _row string, __text string")
    got = dec.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), most_broadcast=most).collect()
    assert len(got) == len(docs)
    expected = want(docs, [x for x in items if x[1]])
    assert sum(map(bool, expected)) > 40
    for r in got:
        assert r._row == "r" and r.item_id == "x"
        assert sorted(((f.item_id, round(f.coverage, 9), f.changed) for f in r.found), key=str) == expected[r.doc_id], docs[r.doc_id][:200]


def test_both_ways_list_items_in_one_order(spark):
    docs, items = rows()
    frame, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, two = ({r.doc_id: r.found for r in dec.decontaminate(frame, bench, most_broadcast=most).collect()} for most in (2_000_000, -1))
    assert one == two
