"""Conversations and personal data against brute force: whole small tables, then nulls, ties, repeats, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import common, private, registry, repair, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def turns():
    rows = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows]


def hostile(seed: int, conversations: int = 120) -> list[tuple]:
    """Rows with nulls, empty and blank texts, foreign roles and repeated turns' texts; each conversation's turns differ."""
    rng, rows = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for turn in rng.sample([None, *range(14)], rng.randint(0, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, turn, role, rng.choice(["a.", "b \n", "", "c!", "d ", "😀.", None, "e?", "\u0085"])))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


# --- Trie --------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, (role or "", text or "")))
    whole = {c: [said for _, said in in_order(r)] for c, r in own.items()}
    rebuilt = {c: whole.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + whole[c][h:] for c in whole}
    members, kids = defaultdict(list), defaultdict(set)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    found = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.append((min(own), len(node), parent, len(own), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(found, key=str)


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=str)


def test_trie_query(spark, turns):
    assert nodes(registry.QUERIES["op13_trie"](spark, SF)) == brute_trie(turns)


@pytest.mark.parametrize("cells", [1, 30, trie.CELLS])
def test_trie_of_hostile_rows_in_blocks_of_any_size(spark, cells):
    common.prepare(spark)
    # Copies of one conversation go over many blocks; some share all but a last turn.
    copies = [(c, t, "user", "same") for c in range(500, 560) for t in range(4 + c % 2)]
    rows = hostile(1) + copies + [(c, t, "u", "first") for c in range(300, 330) for t in range(1)]
    assert nodes(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), cells=cells)) == brute_trie(rows)


def test_trie_of_long_and_no_conversations(spark):
    common.prepare(spark)
    rows = [(c, t, "user", f"turn {t}") for c in (7, 8) for t in range(3000 - c)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "a": F.lit(1)})
    assert nodes(trie.prefix_trie(df, cells=1000)) == brute_trie(rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0


# --- Repair ------------------------------------------------------------------------------------------

LEGAL = {"": "su", "s": "u", "u": "a", "a": "u"}


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        found.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def all_repairs(rows):
    """Least (cost, audit) by trying every edit at every place, insertions up to three in a row."""
    current = {"": {(0, "")}}

    def inserted(current):
        found = {state: set(w) for state, w in current.items()}
        fresh = found
        for _ in range(3):
            more = defaultdict(set)
            for state, weights in fresh.items():
                for role in "ua":
                    if role in LEGAL[state]:
                        more[role] |= {(c + 2, a + "I") for c, a in weights}
            for state, weights in more.items():
                found.setdefault(state, set()).update(weights)
            fresh = {s: set(w) for s, w in more.items()}
        return found

    for (role, _), fault in zip(rows, faults(rows), strict=True):
        after = defaultdict(set)
        for state, weights in inserted(current).items():
            for c, a in weights:
                after[state].add((c + 3, a + "D"))
                if fault in ("blank", "duplicate"):
                    continue
                c += fault == "truncated"
                if role[:1] and role[:1] in LEGAL[state]:
                    after[role[:1]].add((c, a + "K"))
                for new in "ua":
                    if new in LEGAL[state]:
                        after[new].add((c + 2, a + "R"))
        current = {state: {w for w in weights if w[0] == min(weights)[0]} for state, weights in after.items()}
    return min(w for state, weights in inserted(current).items() if state in ("", "a") for w in weights)


def carried_out(rows, audit):
    names, turn, out, rest = {"u": "user", "a": "assistant"}, {"": "u", "s": "u", "u": "a", "a": "u"}, [], iter(rows)
    for edit in audit:
        state = out[-1][0][:1] if out else ""
        role, text = next(rest) if edit != "I" else ("", "")
        if edit != "D":
            out.append((role if edit == "K" else names[turn[state]], text))
    assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out))
    return "\n".join(f"{role}:{text}" for role, text in out)


def brute_repair(rows):
    def said(value):
        return " " if value is None else str(value)

    kept = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if how == 4 else said(role), "" if how == 1 else said(text)
        text = re.sub("[.!?]", "", text) if how == 2 else text
        kept[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    found = []
    for conv, own in kept.items():
        own = in_order(own)
        numbers = {t for t, _, _ in own if t is not None}
        own = [(role, text) for _, role, text in own]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        counts = [faults(own).count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        cost, audit = all_repairs(own)
        found.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(carried_out(own, audit).encode()).hexdigest()))
    return sorted(found, key=str)


CASE = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_query(spark, turns):
    got = registry.QUERIES["op11_repair"](spark, SF).collect()
    assert sorted((tuple(r[c] for c in CASE) for r in got), key=str) == brute_repair(turns)


def test_repair_of_hostile_rows(spark, tmp_path):
    rows = hostile(2, 200)
    spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["op11_repair"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in CASE) for r in got), key=str) == brute_repair(rows)
    assert repair.repaired(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_agenda_equals_all_repairs():
    rng = random.Random(4)
    for _ in range(4000):
        roles = ["system", "user", "assistant", "user", "assistant", "tool", "x", " "]
        rows = [(rng.choice(roles), rng.choice(["a.", "b", "", "c!", "d d", "e.", "f", "g."])) for _ in range(rng.randint(0, 8))]
        own = faults(rows)
        got = repair.lightest_repair([r[:1] for r, _ in rows], [f in ("blank", "duplicate") for f in own], [f == "truncated" for f in own])
        assert got == all_repairs(rows)


def test_agenda_is_linear_in_long_conversations():
    rng, n = random.Random(5), 50_000
    cost, audit = repair.lightest_repair([rng.choice("usa") for _ in range(n)], [False] * n, [rng.random() < 0.1 for _ in range(n)])
    assert cost > 0 and sum(e != "I" for e in audit) == n


# --- Personal data -----------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def right(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if right(k, m.group())]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_private_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = {}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        spans = brute_spans(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want[doc_id] = (*(sum(k == kind for k, _, _ in spans) for kind in PATTERNS), hashlib.sha256(listed.encode()).hexdigest(), listed)
    got = registry.QUERIES["op12_private"](spark, SF).collect()
    assert len(got) == len(docs["doc_id"])
    for r in got:
        *counts, digest, listed = want[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == (*counts, digest)
        assert ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in PATTERNS) == listed


@pytest.mark.parametrize("letters", ["0123456789.", "ab1.@-%+", "0 1-2(3)+4.5", "+1 (2).-@a", "0123456789 -", "中a@.1😀+- ٣٤1", 'token 12:="ab-@.'])
def test_base_spans_equal_the_patterns(letters):
    rng, finder = random.Random(6), private.Finder()
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 34)))
        assert [s for s in finder.spans(text, lowered(text)) if s[0] in PATTERNS] == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 please", "account", "DE89 3704 0044 0532 0130 00"),
        ('Token = "87e15d78b9d8ef29b6c1"', "account", "87e15d78b9d8ef29b6c1"),
        ("account no. 12-345-678.", "account", "12-345-678"),
        ("at https://bob:pw1@host.org:80/x", "link", "https://bob:pw1@host.org:80"),
        ("or mailto:bob@x.org.", "link", "mailto:bob@x.org"),
        ("a token of thanks, version 2.0", "account", None),
        ("http://www.example.org/licenses/LICENSE-2.0", "link", None),
    ],
)
def test_kinds_that_anchors_add(text, kind, found):
    spans = [text[s:e] for k, s, e in private.Finder().spans(text, lowered(text)) if k == kind]
    assert spans == ([found] if found else [])


def test_long_texts_take_linear_time():
    for part in ("a", "1", "+1", "1.", "token ", "://", "a@", "1 ", "http"):
        # The patterns themselves take quadratic time, so they are asked on short texts only.
        assert [s for s in private.Finder().spans(part * 300, part * 300) if s[0] in PATTERNS] == brute_spans(part * 300)
        private.Finder().spans(part * 200_000, part * 200_000)


def test_private_edges(spark):
    common.prepare(spark)
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "a@b.c a@b.c", "x"), (3, "call +49 30 1234567 😀 a@b.c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("kind", F.lit(1))
    got = private.personal_data(docs, mask=True).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), len(r["spans"]), r["kind"]) for r in got) == [
        ("1", "None", 0, 1), ("1", "None", 0, 1), ("2", "", 0, 1), ("3", "call [phone] 😀 [email]", 2, 1), ("None", "[email] [email]", 2, 1),
    ]
    assert private.personal_data(docs.limit(0)).count() == 0
