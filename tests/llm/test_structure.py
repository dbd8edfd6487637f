"""Token alignment, conversation repair and chat formatting against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalforge.llm import alignment, chat_format, conversation_repair, queries
from evalforge.llm.shared import tables

from .conftest import key, make

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A_PATH)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)

# -- alignment --------------------------------------------------------------------------------------------------------


@lru_cache(None)
def token_bytes_a(i: int) -> bytes:
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, n = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + n)
            n += 1
    back = {c: b for b, c in names.items()}
    return bytes(back[c] for c in LIB_A.id_to_token(i))


@lru_cache(None)
def token_bytes_b(i: int) -> bytes:
    piece = LIB_B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x..>", piece) else piece.replace("▁", " ").encode()


def plain_alignment(text: str | None):
    """(A ids, B ids, links of places, groups) of the whole text at once; nothing where a side doesn't give it back."""
    whole = (" " + text).encode() if text else b""
    a, b = LIB_A.encode(" " + (text or ""), add_special_tokens=False).ids, LIB_B.encode(text or "")
    spans_a, spans_b = [], []
    for ids, spans, of in ((a, spans_a, token_bytes_a), (b, spans_b, token_bytes_b)):
        at = 0
        for i in ids:
            spans.append((at, at + len(of(i))))
            at += len(of(i))
    if not text or b"".join(map(token_bytes_a, a)) != whole or b"".join(map(token_bytes_b, b)) != whole:
        return [], [], [], []
    links, k = [], 0
    for x, (s, e) in enumerate(spans_a):
        while k and spans_b[k - 1][1] > s:
            k -= 1
        while k < len(b) and spans_b[k][0] < e:
            if spans_b[k][1] > s:
                links.append((x, k))
            k += 1
    both = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    end_a, end_b = {e: k + 1 for k, (_, e) in enumerate(spans_a)}, {e: k + 1 for k, (_, e) in enumerate(spans_b)}
    groups, x, y = [], 0, 0
    for end in both:
        groups.append((a[x : end_a[end]], b[y : end_b[end]]))
        x, y = end_a[end], end_b[end]
    return a, b, links, groups


def plain_table(texts: list[tuple]):
    found = [plain_alignment(t) for _, t in texts]
    count = Counter(p for a, b, links, _ in found for p in {(a[x], b[y]) for x, y in links})
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (a, b, links, groups) in zip(texts, found):
        ids = [(a[x], b[y]) for x, y in links]
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(ids), sum(count[p] == most[p[0]] for p in ids), sum(count[p] for p in ids), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return tuple(sorted(tuple("~" if v is None else str(v) for v in r) for r in out))


NAMES = ("doc_id", *alignment.COLUMNS[:4], "n_best", "count_sum", "groups_sha256")
SHORT = [r[:2] for r in make() if r[1] is None or len(r[1]) < 3000] + [
    (300, "a▁b and more"), (301, "  two  spaces  "), (302, "end with space "), (303, "nbsp  then 　 wide   em"), (304, "tab\t and\n new \r\n lines"), (305, "nul\0byte \x1f \x7f del"), (306, "<|endoftext|> <s> </s> <0x0A>"), (307, "漢字。 é» ° x"), (308, " "),
]


def aligned_frame(spark, rows=SHORT):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, pair long, n_a string").repartition(3)


def test_alignment_equals_whole_texts(spark):
    assert key(alignment.alignment(aligned_frame(spark), A_PATH, B_PATH).collect(), *NAMES) == plain_table(SHORT)


def test_alignment_beyond_the_table_of_frequent_pairs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "TOP", 40)
    monkeypatch.setattr(alignment, "HELD", 100)
    monkeypatch.setattr(alignment, "AT_ONCE", 100)
    assert key(alignment.alignment(aligned_frame(spark), A_PATH, B_PATH).collect(), *NAMES) == plain_table(SHORT)
    monkeypatch.setattr(alignment, "TOP", 0)
    assert key(alignment.alignment(aligned_frame(spark), A_PATH, B_PATH).collect(), *NAMES) == plain_table(SHORT)


def test_alignment_of_long_texts_and_none(spark, docs, rows):
    long = [r[:2] for r in rows if r[1] and len(r[1]) >= 3000]
    got = alignment.alignment(docs.filter(F.length("text") >= 3000), A_PATH, B_PATH).collect()
    assert key(got, *NAMES) == plain_table(long)
    assert alignment.alignment(aligned_frame(spark).filter("doc_id < -5"), A_PATH, B_PATH).count() == 0


def test_alignment_of_nothing_but_empty_texts(spark):
    got = alignment.alignment(aligned_frame(spark, [(1, None), (2, "")]), A_PATH, B_PATH).collect()
    assert key(got, *NAMES) == plain_table([(1, None), (2, "")])


def test_aligned_tokens(spark):
    got = {r["doc_id"]: r for r in alignment.aligned_tokens(aligned_frame(spark, SHORT[-9:]), A_PATH, B_PATH).collect()}
    for i, t in SHORT[-9:]:
        a, b, links, groups = plain_alignment(t)
        assert (got[i]["a_ids"], got[i]["b_ids"], [(x["a"], x["b"]) for x in got[i]["links"]], len(got[i]["cuts"])) == (a, b, links, len(groups))
        assert not groups or got[i]["cuts"][-1] == len((" " + t).encode())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's tz \n\t12!?é\u00a0\u3000 \u2028▁漢²½»。\"'😀<|>")), max_size=40), min_size=1, max_size=6))
def test_parts_give_the_tokens_of_whole_texts(texts):
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids_a, ends_a, ids_b, ends_b = alignment.both_ids(A_PATH, B_PATH, data, offsets)
    size_a, size_b = alignment.sizes(A_PATH, B_PATH)
    for t, a, b in zip(texts, np.split(ids_a, ends_a[:-1]), np.split(ids_b, ends_b[:-1])):
        found = alignment.align(size_a[a], size_b[b])
        want_a, want_b, links, groups = plain_alignment(t)
        assert (a.tolist(), b.tolist(), list(zip(found.link_a.tolist(), found.link_b.tolist())), len(found.ends)) == (want_a, want_b, links, len(groups))


# -- conversation repair ----------------------------------------------------------------------------------------------


def plain_repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost and ASCII-least audit of (initial, fault) rows, by the first edit and what is best after it."""

    @lru_cache(None)
    def best(i: int, last: str, row: int):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, ""))
        if row < 3:  # more insertions in a row never help
            for r in "ua":
                if (last, r) in {("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    found.append((3, "I", i, r, row + 1))
        if i < len(rows):
            initial, fault = rows[i]
            found.append((4, "D", i + 1, last, row))
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                for letter, r, cost in [("K", initial, 0), ("R", "u", 3), ("R", "a", 3)]:
                    if (last, r) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                        found.append((cost + extra, letter, i + 1, r, 0))
        out = []
        for f in found:
            if len(f) == 2:
                out.append(f)
            elif (rest := best(*f[2:])) is not None:
                out.append((f[0] + rest[0], f[1] + rest[1]))
        return min(out) if out else None

    return best(0, "", 0)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=9))
def test_repair_is_cheapest_and_least(rows):
    turns = conversation_repair.Turns()
    for r in rows:
        turns.add(*r)
    assert turns.close() == plain_repair(rows)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_conversations(rows):
    kept = defaultdict(list)
    for r in plain_damage(rows):
        kept[r[0]].append(r)
    result = []
    for conv in {r[0] for r in rows}:
        own = sorted(kept[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = plain_repair(list(zip([r[2][:1] for r in own], faults)))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        out, k = [], 0
        for letter in audit:
            flip = "assistant" if out and out[-1][0][:1] == "u" else "user"
            if letter == "I":
                out.append((flip, ""))
                continue
            if letter != "D":
                out.append((own[k][2] if letter == "K" else flip, own[k][3]))
            k += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        result.append((conv, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()))
    return tuple(sorted(tuple("~" if v is None else str(v) for v in r) for r in result))


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TALK = "conv_id long, turn long, role string, text string, digest string, kind string, fault int"


def talk():
    import random

    rng = random.Random(5)
    texts = ["Fine.", "fine", "", " \t\n", None, "Why?", "So!\n ", "word " * 400 + ".", "é。", "no end \n"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += [rows[0]] * 2 + [(999, t, ("user", "assistant")[t % 2], f"turn {t}{'.' if t % 7 else ''}") for t in range(5000)]
    return rows


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], TALK).repartition(3)


def test_conversations_are_repaired_as_by_plain_search(spark, monkeypatch):
    import sys

    monkeypatch.setattr(sys, "setrecursionlimit", sys.setrecursionlimit)
    sys.setrecursionlimit(40_000)
    rows = [r for r in talk() if r[0] != 999 or r[1] < 900]
    got = conversation_repair.repair(conversation_repair.damaged(talk_frame(spark, rows))).collect()
    assert key(got, *REPAIR) == plain_conversations(rows)


def test_repair_of_a_long_conversation_and_of_none(spark):
    rows = talk()
    damaged = conversation_repair.damaged(talk_frame(spark, [r for r in rows if r[0] == 999]))
    (got,) = conversation_repair.repair(damaged).collect()
    out = conversation_repair.repaired(damaged).orderBy("position").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in out))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in out).encode()).hexdigest() == got["repaired_sha256"]
    assert got["audit"].count("K") + got["audit"].count("R") + got["audit"].count("D") == len(plain_damage([r for r in rows if r[0] == 999]))
    assert conversation_repair.repair(conversation_repair.damaged(talk_frame(spark, rows[:1]).filter("1 = 0"))).count() == 0


def test_a_conversation_that_is_dropped_whole(spark):
    gone = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (got,) = conversation_repair.repair(conversation_repair.damaged(talk_frame(spark, [(gone, 0, "user", "Hi.")]))).collect()
    assert tuple(got) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# -- chat formatting --------------------------------------------------------------------------------------------------


def plain_chat(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in own.items():
        turns.sort(key=lambda t: t[:2])
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return tuple(sorted(tuple("~" if v is None else str(v) for v in r) for r in out))


CHAT = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
CONTROLS = chat_format.Template().controls


def chat_rows():
    rows, seen = [], set()
    for r in talk():
        while r[:2] in seen:  # rows of one turn have no order that a plain version knows, but for equal ones
            r = (r[0], (r[1] or 0) + 100, *r[2:])
        seen.add(r[:2])
        rows.append(r)
    tricky = ["".join(CONTROLS), "<<s>s>\\</s>\\\\[INST]", "\\", "<\\s>", "漢😀" * 3000, "a" * 5000 + "<|end|>", "<|turn|>user<|text|>x<|end|>"]
    rows += [(2000 + k % 3, k, ("assistant", "user", "<|end|>\\")[k % 3], t) for k, t in enumerate(tricky * 2)]
    return rows + [(3000, 1, "assistant", "twice")] * 2


@pytest.mark.parametrize("part", [chat_format.PART, 50])
def test_chat_is_read_back_as_it_was_said(spark, monkeypatch, part):
    monkeypatch.setattr(chat_format, "PART", part)
    rows = chat_rows()
    parts = chat_format.render(chat_format.log(talk_frame(spark, rows)))
    assert key(chat_format.read_back(parts, arranged=True).collect(), *CHAT) == plain_chat(rows)
    stored = spark.createDataFrame(parts.collect(), parts.schema).repartition(5)
    assert key(chat_format.read_back(stored).collect(), *CHAT) == plain_chat(rows)
    if part == 50:
        assert parts.filter("part > 0").count() > 0


def test_no_control_string_is_left_in_what_was_said(spark):
    t = chat_format.Template()
    for r in chat_format.render(chat_format.log(talk_frame(spark, chat_rows()))).collect():
        bare = t.turns.sub(lambda m: m[1] + "\0" + m[2], r["formatted"])
        assert not any(c in bare for c in t.controls)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*CONTROLS, "\\", "<", ">", "|", "[", "INST]", "s>", "x", "\n"]), max_size=12))
def test_hiding_is_undone(parts):
    t, text = chat_format.Template(), "".join(parts)
    assert t.show(t.hide(text)) == text and not any(c in t.hide(text) for c in t.controls)


def test_events_fold_into_final_messages(spark):
    said = [
        (1, 0, 0, 0, "open", "user"), (1, 0, 0, 1, "delta", "he"), (1, 0, 0, 2, "delta", "llo"),
        (1, 1, 0, 0, "open", "assistant"), (1, 1, 0, 1, "delta", "bad"), (1, 1, 0, 2, "regenerate", None), (1, 1, 0, 3, "delta", "go"), (1, 1, 0, 4, "delta", "od"),
        (1, 2, 0, 0, "open", "user"), (1, 2, 0, 1, "delta", "tpyo"), (1, 2, 0, 2, "edit", "typ"), (1, 2, 0, 3, "delta", "o"), (1, 2, 0, 4, "other", "x"),
        (None, None, 0, 0, "delta", "no role"), (2, 0, 0, 0, "open", None), (2, 1, 0, 0, "regenerate", None),
    ]
    events = spark.createDataFrame(said[::-1], "conv_id long, turn long, key long, seq long, kind string, value string").repartition(4)
    got = sorted(((r["conv_id"] or -1, r["position"], r["role"], r["text"]) for r in chat_format.messages(events).collect()))
    assert got == [(-1, 0, "", "no role"), (1, 0, "user", "hello"), (1, 1, "assistant", "good"), (1, 2, "user", "typo"), (2, 0, "", "")]
    assert chat_format.render(events.filter("1 = 0")).count() == 0


def test_chat_query_adds_the_conversation_of_control_strings(spark):
    (got,) = queries.op13_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -1").collect()
    text = queries.CONTROL_TEXT
    assert (got["n_turns"], got["loss_chars"]) == (2, len(text))
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert tables(spark, "/root/testdata/sf0.001", "conversations").filter("conv_id = -1").count() == 0
