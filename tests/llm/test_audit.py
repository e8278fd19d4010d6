"""Filter interactions against applying the five filters in every order, one document after another."""

import random
import re
from collections import Counter
from itertools import permutations

from bandloom.llm import audit

RND = random.Random(4)


def words(n, distinct):
    return " ".join(f"w{RND.randrange(distinct)}" for _ in range(n))


def texts():
    fixed = [None, "", " \t\n", "A#", "ABC def", words(99, 10**6), words(100, 10**6), "#" + words(120, 10**6), words(200, 20), words(150, 10**6).upper(), "x\x0by\x1fz q " * 60, "É" * 400, "long Words " * 9000]
    return fixed + [RND.choice([words(RND.randint(80, 130), RND.choice([40, 10**6])), words(110, 10**6).title(), "a | b " + words(120, 10**6)]) for _ in range(30)]


def failing(rows):
    """The letters that each row fails."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows),
        }
        out.append({c for c, failed in fails.items() if failed})
    return out


def expected(rows, good, toxic):
    fails, out, total = failing(rows), {}, Counter()
    for part in {r[2] or "" for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                n = Counter()
                for (doc_id, _, lang, *_), own in zip(rows, fails, strict=True):
                    if (lang or "") != part:
                        continue
                    gone = bool(own & set(order[: step - 1]))
                    n["kept"] += not gone and letter not in own
                    n["redundant"] += gone and letter in own
                    n["unique"] += own == {letter}
                    if not gone and letter in own:
                        n["removed"] += 1
                        n["good"] += doc_id in good
                        n["toxic"] += doc_id in toxic
                out[part, order, step] = n
                total[part, letter] += n["removed"]
    return {key: (*(n[c] for c in ("kept", "removed", "redundant", "unique", "good", "toxic")), total[key[0], key[1][key[2] - 1]]) for key, n in out.items()}


def test_against_every_order(spark):
    """Null and empty texts and langs, copies, repeated rows and ids, rows without ids, labels that repeat or are null, clashing columns."""
    pool = texts()
    rows = [(i, RND.choice(pool), RND.choice(["en", "fr", "", None])) for i in range(150)]
    rows += [rows[3], rows[3], (4, "other text", "en"), (None, pool[3], "en"), (None, pool[3], None), (500, words(130, 10**6), "de")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(8, 1, None), (8, 0, 1), (None, 1, 1), (9, None, None)]
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, mask long, part string").repartition(3)
    found = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, digest string")
    got = audit.audit(docs, found).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got} == expected(rows, good, toxic)
    assert len(got) == 4 * 600


def test_other_letters_and_no_rows(spark):
    kinds = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
    assert audit.audit(*(spark.createDataFrame([], k) for k in kinds)).count() == 0
    masks = spark.createDataFrame([("p", 1, 0, 0), ("p", 3, 1, 0), ("p", 0, 0, 0)], "part string, mask int, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit.interactions(masks, "AB").collect()}
    assert got == {("AB", 1): (1, 2, 0, 1, 1, 3), ("AB", 2): (1, 0, 1, 0, 0, 1), ("BA", 1): (2, 1, 0, 0, 1, 1), ("BA", 2): (1, 1, 1, 1, 0, 3)}
