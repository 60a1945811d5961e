"""Altered licences inside prose against the Dice of every window of every length."""

import random
import re

from factloom.llm import licenses


def words_of(text):
    return [w for w in re.sub(r"[^\w]+|_", " ", text.lower()).split() if w]


def brute(text, template):
    """Greatest Dice of any window of a text's word pairs with a template."""
    pairs, wanted = list(zip(words_of(text), words_of(text)[1:], strict=False)), set(zip(words_of(template), words_of(template)[1:], strict=False))
    best = 0.0
    for start in range(len(pairs)):
        seen, common = set(), 0
        for p in pairs[start : start + 3 * len(wanted) + 8]:
            if p not in seen:
                seen.add(p)
                common += p in wanted
            best = max(best, 2 * common / (len(seen) + len(wanted)))
    return best


def test_windows_against_every_window(spark):
    r, rows = random.Random(12), []
    prose = lambda n: " ".join("".join(r.choices("abcdeghilmnorstu", k=r.randint(2, 8))) for _ in range(n))
    for name, text in [x for x in licenses.NOTICES if x[0] != "all-rights-reserved"] + list(licenses.TEXTS):
        for share in (0.0, 0.04, 0.08, 0.12, 0.3):
            altered = [w if r.random() >= share else prose(1) for w in text.split()]
            rows.append((len(rows), prose(60) + "\n" + " ".join(altered) + "\n" + prose(60), name, text))
    found = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    clear = missed = 0
    for i, text, name, template in rows:
        most = brute(text, template)
        got = found[i]
        if most >= 0.86:  # windows go in steps, so only what lies clearly above the threshold must be found
            clear += 1
            missed += got.license is None
        if got.license is None:
            assert got.dice == 0 and most < 0.9, (name, most)
        elif got.license == name and sum(n == name for n, _ in licenses.NOTICES + licenses.TEXTS) == 1:
            assert got.dice <= most + 1e-6
        assert got.license is None or got.dice >= licenses.THRESHOLD
    assert clear > 60 and missed <= 0.02 * clear
