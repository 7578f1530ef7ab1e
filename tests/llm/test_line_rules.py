import re

import fixtures
import pytest

from minekit.llm import line_rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_figures_equal_brute_force(docs):
    data = [r for r in fixtures.rows() if r[0] != 1000]
    want = sorted(tuple(map(repr, (r[0], *brute(r[1] or "")))) for r in data)
    got = line_rules.clean_lines(docs.where("doc_id != 1000 or doc_id is null"))
    assert fixtures.pairs(got, *NAMES) == want
    assert all(not (r.kept and r.base_failed) for r in got.collect())


def test_bad_lines_go(spark):
    good = "\n".join(f"Sentence number {i} tells {i * i} things of {i + 1} people." for i in range(12))
    text = f"{good}\nHome | About | Login | More\nCLICK HERE NOW TO WIN!! TODAY!!\nlogin to read more\n"
    (row,) = line_rules.clean_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert row.kept and row.clean_text.strip() == good
    junk = "\n".join(f"{i}Home | About{i} | Login | More{i}" for i in range(30))
    (row,) = line_rules.clean_lines(spark.createDataFrame([(1, f"{good[:200]}\n{junk}")], "doc_id int, text string")).collect()
    assert not row.base_failed and not row.kept


@pytest.mark.parametrize("line,rule", [
    ("A | B | C", "navigation"), ("the&&& thner*** of%%%", "punctuation"), ("WORDS!! IN!! CAPITALS!!", "punctuation"),
    ("ALL OF THIS IS LOUD", "punctuation"), ("All rights reserved.", "boilerplate"), ("A fine line of text.", None), ("Title", None),
])
def test_line_rule(line, rule):
    assert line_rule_of(line) == rule


def line_rule_of(line):
    return line_rules.line_rule(line)


def test_empty_table(no_docs):
    assert line_rules.clean_lines(no_docs).collect() == []
