"""Line quality against brute force, its hot groups, and private data in texts with very many matches."""

import random
import re
from collections import Counter, defaultdict

import pytest

from recordweave.llm.line_quality import clean_documents, line_quality
from recordweave.llm.private_data import find_private_data, redact

BLANKS = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w, lines, seen, again = words(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            again += line in seen
            seen.add(line)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered), failed


def brute(rows, limit=20, least=0.3):
    """Verdicts where no document is a near copy of another; equal texts of a host count once."""
    normal = lambda line: " ".join(words("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))
    holders = defaultdict(set)
    for _, text, host in rows:
        content = tuple(normal(x) for x in (text or "").split("\n") if words(x))
        for line in content:
            holders[host, line].add(content)
    out = []
    for i, text, host in rows:
        measured = base(text)
        gone = sum(len(words(x)) for x in (text or "").split("\n") if words(x) and len(holders[host, normal(x)]) > limit)
        left = 1 - gone / measured[0] if measured[0] else 0
        out.append((i, *measured, not measured[-1] and left >= least))
    return out


def test_line_quality_against_brute_force(documents):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdeÄß#$%&|<>*éZ") for _ in range(draw.randint(1, 7))) for _ in range(4000)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    menu, notice = " ".join(some(30)), " ".join(some(9))
    rows = []
    for i in range(260):
        lines = [draw.choice(BLANKS.replace("\n", "")).join(some(draw.randint(0, 14))) for _ in range(draw.randint(1, 12))]
        host = draw.choice(["a", "a", "b", None])
        if i % 4 == 0:
            lines.insert(draw.randint(0, len(lines)), menu.upper() if i % 8 else menu + "  ")
        if i % 13 == 0:
            lines += [notice] * draw.randint(1, 9)
        if i % 17 == 0:
            lines += lines[:2]
        rows.append((i, "\n".join(lines), host))
    rows += [(900, None, "a"), (901, "", "a"), (902, "\x00   \x1f", "b"), (903, "a b c " * 40, "b"), (904, "𝄞" * 70 + " x" * 60, None)]
    got = line_quality(documents(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert 20 < sum(r[-1] for r in want) < len(rows) - 20


def test_a_share_of_none_keeps_the_number_for_large_hosts(documents):
    draw = random.Random(2)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    menu = prose(30)
    rows = [(i, f"{menu}\n{prose(60)}", "s") for i in range(25)] + [(100 + i, f"own line {i}", "s") for i in range(30_000)]
    assert line_quality(documents(rows)).where("n_removed_words > 0").count() == 0
    assert line_quality(documents(rows), share=0.0).where("n_removed_words > 0").count() == 25


@pytest.mark.parametrize("edits", [1, 3])
def test_a_large_group_of_near_copies_stays(documents, edits):
    draw = random.Random(edits)
    lines = [" ".join("".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(12)) for _ in range(12)]
    rows = []
    for i in range(1500):
        text = [x.split() for x in lines]
        for e in range(edits):
            text[draw.randrange(12)][draw.randrange(12)] = f"edit{i}x{e}"
        rows.append((i, "\n".join(map(" ".join, text)), "s"))
    assert line_quality(documents(rows)).where("kept").count() == 1500
    assert clean_documents(documents(rows)).select("text").distinct().count() == 1500


def test_very_many_matches_in_one_text(documents):
    n = 100_000
    rows = [(1, "mail a.b@c.de now " * n, "s"), (2, "no data here", "s")]
    found = {r.doc_id: r for r in find_private_data(documents(rows)).collect()}
    assert found[1].n_email == n and found[2].spans == ""
    cleaned = {r.doc_id: r.text for r in redact(documents(rows)).collect()}
    assert cleaned == {1: "mail <EMAIL> now " * n, 2: "no data here"}


def test_redaction_cuts_at_any_place(documents):
    draw = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        text, out = "", ""
        for _ in range(draw.randint(0, 30)):
            filler = " " + "".join(draw.choice("abc ä𝄞\n") for _ in range(draw.choice([1, 3, 500, 511, 512, 1100]))) + " "
            text, out = text + filler + "joe@x.org", out + filler + "<EMAIL>"
            if draw.random() < 0.3:
                text, out = text + "  10.0.0.1", out + "  <IP>"
        tail = "".join(draw.choice(" ä𝄞") for _ in range(draw.randint(0, 600)))
        rows.append((i, text + tail, "s"))
        want[i] = out + tail
    assert {r.doc_id: r.text for r in redact(documents(rows)).collect()} == want
