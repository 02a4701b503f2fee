"""Nothing that a rule matches is lost before the rule is tried."""

import random
import re

import pytest

import cases
from sharelode.llm import licenses

TEXTS = {
    "CC0 1.0 Universal": "cc0", "All rights reserved.": "all-rights-reserved", "Released under the GPLv3": "unknown-license",
    "available under the GPL v3": "gpl-3", "see https://www.mozilla.org/MPL/2.0/": "mpl-2.0",
    "https://scripts.sil.org/OFL": "ofl", "https://www.eclipse.org/legal/epl-2.0": "epl-2.0",
    "it is public\ndomain": "public-domain", "Creative\nCommons Attribution 4.0": "cc-by-4.0",
    "provided without warranties or conditions": "no-warranty", "http://www.gnu.org/copyleft/gpl.html": "gpl",
    "permission is\n hereby granted, free of charge": "permission-notice", "the BSD 3-Clause": "bsd-3-clause",
    "provided by the terms of the MIT": "mit", "distributed under": "unknown-license", "http://www.wtfpl.net/": "wtfpl",
}


def matched(text):
    """Labels that are left of what all rules find, with neither gate nor keywords."""
    joined = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', cases.lower(text)))} "
    found = [(m.start(), m.end(), priority, place, label)
             for place, (label, priority, _, pattern) in enumerate(licenses.rules())
             for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined)]

    def out(d):
        return any(o[0] < d[1] and o[1] > d[0] and o[2] > d[2]
                   or o[0] <= d[0] and o[1] >= d[1] and o[2] == d[2]
                   and (o[1] - o[0] > d[1] - d[0] or o[:2] == d[:2] and o[3] < d[3]) for o in found)

    return sorted((d[0], d[1], d[2], d[4]) for d in found if not out(d))


def test_all_patterns_without_gate_and_keywords(spark):
    texts = [*TEXTS, "a " + " and\t".join(TEXTS), "nothing here", *(t.upper() for t in TEXTS)]
    found = licenses.scan(cases.frame(spark, list(enumerate(texts)))).collect()
    for r in found:
        expected = matched(texts[r.doc_id])
        assert sorted((d["from"], d["to"], d.priority, d.label) for d in r.detections) == expected
        assert r.score == max((d[2] for d in expected), default=0) / 100
        if r.doc_id < len(TEXTS):
            assert TEXTS[texts[r.doc_id]] in r.labels.split(",")


def sample(pattern, rng):
    """A text that the pattern matches."""
    while (group := re.search(r"\(\?:([^()]*)\)(\??)", pattern)):
        one = rng.choice(group[1].split("|")) if not group[2] or rng.random() < 0.5 else ""
        pattern = pattern[:group.start()] + one + pattern[group.end():]
    pattern = rng.choice(pattern.split("|"))
    pattern = re.sub(r"\[(.)[^]]*\]([*+]?)", lambda m: m[1] * (rng.choice([1, 2]) if m[2] else 1), pattern)
    return re.sub(r"(.)\?", lambda m: rng.choice(["", m[1]]), pattern)


@pytest.mark.parametrize("seed", range(4))
def test_every_rule_gets_through(seed):
    rng = random.Random(seed)
    for _, _, keyword, pattern in licenses.rules():
        for _ in range(5):
            text = sample(pattern, rng)
            assert re.fullmatch(pattern, text), (pattern, text)
            assert keyword in f" {text} ", (pattern, text)
            raw = re.sub(" ", lambda _: rng.choice([" ", "\n", "-", ".", "/", " (", "_"]), text)
            raw = f"x{rng.choice(' ./(')}{rng.choice([raw, raw.upper(), raw.title()])}."
            assert re.search(licenses._GATE, raw), (pattern, raw)
