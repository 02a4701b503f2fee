"""A text full of license phrases takes time in proportion to its length."""

import time

import pytest
from pyspark.sql import functions as F

import cases
from sharelode.llm import licenses
from test_licenses import brute

LINES = [
    "Licensed under the Apache License, Version 2.0.", "released under the MIT License", "CC BY-SA 4.0",
    "the GNU Lesser General Public License v2.1 or later", "SPDX-License-Identifier: GPL-2.0-or-later", "All rights reserved.",
    "https://creativecommons.org/licenses/by-sa/4.0/", "dedicated to the public domain", "without any warranty", "plain words",
]


def text(n):
    """Some `n` words of license lines."""
    lines, words = [], 0
    while words < n:
        lines.append(LINES[(len(lines) * 7 + len(lines) // 9) % len(LINES)])
        words += len(lines[-1].split())
    return "\n".join(lines)


def rows(found):
    return sorted((d["from"], d["to"], d.priority, d.place, d.label) for d in found)


@pytest.mark.parametrize("n", [1, 40, 700, 2500])
def test_long_texts_against_plain_expressions(spark, n):
    r = licenses.scan(cases.frame(spark, [(1, text(n))])).first()
    words, base, left = brute(text(n))
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), base[0][0], base[-1][0])
    assert rows(r.detections) == sorted(left) and len(left) > n // 20


@pytest.mark.parametrize("sizes", [(1,), (127, 128, 129), (255, 256, 257, 1000, 20_000)])
def test_running(spark, sizes):
    for n in sizes:
        values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x * 37 % 101)
        r = spark.range(1).select(licenses._running(values, lambda a, b: a + b).alias("sums"),
                                  licenses._running(values, F.greatest).alias("most")).first()
        total = most = 0
        for i in range(n):
            x = (i + 1) * 37 % 101
            total, most = total + x, max(most, x)
            assert (r.sums[i], r.most[i]) == (total, most)


def test_time_in_proportion(spark):
    def seconds(n):
        start = time.perf_counter()
        found = licenses.scan(cases.frame(spark, [(1, text(n))])).select(F.size("detections")).first()[0]
        assert found > n // 20
        return time.perf_counter() - start

    seconds(20)
    fixed = min(seconds(20) for _ in range(2))
    assert seconds(20_000) - fixed < 5
