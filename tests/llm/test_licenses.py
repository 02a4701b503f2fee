import re

import pytest

import cases
from sharelode.llm import licenses

TEXTS = [
    None, "", "nothing here", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "acc by, cc-by!",
    "This work is licensed under the GNU General Public License, version 3. MIT License MIT  license",
    "mit license mit license apache license" * 3, "SPDX-License-Identifier: GPL-2.0-or-later",
    "released under the MIT License.\nAll rights reserved", "écc by", "GNU GENERAL PUBLIC\tLICENSE", "İ cc by",
    "see https://creativecommons.org/licenses/by-sa/4.0/ and http://www.gnu.org/licenses/lgpl-3.0.html",
    "the GNU Lesser General Public License v2.1 or the GNU Affero General Public License",
    "word " * 3000 + "Apache License " + "word " * 3000, "public domain", "license", "cc by" * 50,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[4])]


def brute(text):
    """Words, base places with labels, and detections that are left."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cases.lower(text))
    base = []
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    found = []
    if re.search(licenses._GATE, text or ""):
        joined = f" {' '.join(words)} "
        for place, (label, priority, keyword, pattern) in enumerate(licenses.rules()):
            if keyword in joined:
                found += [(m.start(), m.end(), priority, place, label)
                          for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined)]

    def out(d):
        for o in found:
            inside = o[0] <= d[0] and o[1] >= d[1]
            overlaps = o[0] < d[1] and o[1] > d[0]
            longer = o[1] - o[0] > d[1] - d[0] or o[:2] == d[:2] and o[3] < d[3]
            if overlaps and o[2] > d[2] or inside and o[2] == d[2] and longer:
                return True
        return False

    return words, sorted(base), [d for d in found if not out(d)]


def test_against_plain_expressions(spark):
    found = licenses.scan(cases.frame(spark, ROWS)).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found}
    for doc_id, text in ROWS:
        words, base, left = brute(text)
        r = by_id[doc_id]
        assert r.n_words == len(words) and r.n_base == len(base)
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        labels = sorted({label for _, label in base})
        assert r.base_labels == ",".join(labels)
        assert r.labels == ",".join(sorted({*labels, *(d[4] for d in left)}))
        assert r.score == max((d[2] for d in left), default=0) / 100
        assert sorted((d["from"], d["to"], d.priority, d.place, d.label) for d in r.detections) == sorted(left)


@pytest.mark.parametrize("text, label", [
    (TEXTS[3], "apache-2.0"), (TEXTS[4], "cc-by-nc-4.0"), (TEXTS[6], "gpl-3"), (TEXTS[8], "gpl-2"),
    (TEXTS[13], "cc-by-sa"), (TEXTS[14], "lgpl-2.1"), ("dedicated to the public domain", "public-domain")])
def test_labels(spark, text, label):
    assert label in licenses.scan(cases.frame(spark, [(1, text)])).first().labels.split(",")


def test_longer_names_win(spark):
    assert licenses.scan(cases.frame(spark, [(1, "the GNU Lesser General Public License v2.1")])).first().labels == "lgpl-2.1"


def test_hundreds_of_rules_and_no_python(spark):
    assert len(licenses.rules()) > 300
    plan = licenses.scan(cases.frame(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert licenses.scan(cases.frame(spark, [])).count() == 0
