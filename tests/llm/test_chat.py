import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from webquarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, ids string, n_turns int, head string, learned int"
BITS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|end|>", "\\", "<", "[", "<\\s>", "[\\\\INST]", " ", "é", "日本", "👍", "\n", "a", "", "<s", "|>", "\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    return chat.read_vocabulary()


def table(spark, rows):
    """Turns with extra columns named like the operator's own."""
    return spark.createDataFrame([(*r, 1, "x", 2, "h", 3) for r in rows], SCHEMA)


def brute(rows, template):
    """What the contract's columns must be, from the rows alone; rows of one conversation and turn in the order given."""
    convs = defaultdict(list)
    for at, (conv, turn, role, text) in enumerate(rows):
        convs[conv].append((turn is None, turn or 0, at, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[3:] for t in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        written = len(template.begin)
        for r, t in turns:
            around = template.turns.get(r, template.other)
            written += sum(map(len, around)) + len(template.escape(t)) + (0 if r in template.turns else len(template.escape(r)))
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), digest(said), len(loss), digest(loss), written)
    return out


def check(spark, rows, vocabulary, **options):
    template = chat.Template()
    made = chat.format_conversations(table(spark, rows).coalesce(1), vocabulary, **options)
    got = chat.read_back(made, vocabulary).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute(rows, template)
    assert len({r["conv_id"] for r in got}) == len(got)
    return made


def test_escaping_is_undone_and_leaves_no_control_string():
    template, pick = chat.Template(), random.Random(3)
    texts = ["".join(pick.choices(BITS, k=pick.randrange(9))) for _ in range(3000)] + ["<" * 50 + "s>", "\\" * 30, "<\\\\\\s>"]
    for t in texts:
        safe = template.escape(t)
        assert template.unescape(safe) == t
        assert not any(c in safe for c in template.controls)


def test_overlapping_control_strings_are_refused():
    for bad in ("<s", "<s>x", "s>q", "a\\b", "x"):
        with pytest.raises(ValueError):
            chat.Template(begin="<s>", other=(bad, "<|text|>", "<|end|>"))


def test_mask_by_prefix_sums_against_a_loop():
    pick = random.Random(5)
    for _ in range(50):
        turns = [(pick.randrange(1, 4), pick.randrange(5), pick.random() < 0.5) for _ in range(pick.randrange(1, 9))]
        want = [int(learned and h <= i < h + n) for h, n, learned in turns for i in range(h + n + 1)]
        lengths = np.array([h + n + 1 for h, n, _ in turns])
        got = chat.loss_mask(lengths, np.array([h for h, _, _ in turns]), np.array([n for _, n, _ in turns]), np.array([x for *_, x in turns], np.int64))
        assert got.tolist() == want


@pytest.mark.parametrize("row_tokens", [1 << 16, 20])
def test_round_trip_against_the_rows(spark, vocabulary, row_tokens):
    pick = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "assistant ", "<s>", "a\nb", None, ""]
    rows = []
    for conv in [*range(60), None, -7]:
        for turn in range(pick.randrange(1, 9)):
            rows.append((conv, turn, pick.choice(roles), pick.choice((None, "", "".join(pick.choices(BITS, k=12)), "plain words here"))))
    # Ties of a turn, a null turn, repeated rows, only an assistant.
    rows += [(900, 1, "user", "b"), (900, 1, "user", "a"), (900, None, "assistant", "last"), (900, 1, "user", "b"), (901, 0, "assistant", "only"), (901, 1, "assistant", "twice")]
    check(spark, rows, vocabulary, row_tokens=row_tokens)


def test_parts_of_a_long_conversation(spark, vocabulary):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} " * 30) for t in range(300)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "é " * 100_000)]
    made = check(spark, rows, vocabulary, row_tokens=500)
    parts = made.selectExpr("conv_id", "part", "size(ids) AS n", "size(loss_mask) AS m").collect()
    assert all(r["n"] == r["m"] for r in parts)
    assert max(r["n"] for r in parts if r["conv_id"] == 1) < 600 and len(parts) > 20
    # Rows from a file, in any order, are put in order first.
    again = chat.read_back(chat.in_order(made.repartition(7)), vocabulary).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in again} == brute(rows, chat.Template())


def test_no_turns(spark, vocabulary):
    made = chat.format_conversations(table(spark, []), vocabulary)
    assert made.count() == 0 and chat.read_back(made, vocabulary).count() == 0


def test_texts_hold_no_reserved_id(spark, vocabulary):
    codec = chat.Codec(vocabulary, chat.Template())
    rows = [(1, 0, "user", "".join(chat.Template().controls))]
    ids = chat.format_conversations(table(spark, rows), vocabulary).first()["ids"]
    assert [codec.template.controls[i - codec.first] for i in ids if i >= codec.first] == ["<s>", "[INST]", "[/INST]"]


def test_query_against_its_sql(spark, sf):
    import duckdb

    from webquarry.llm import queries

    got = queries.op12_chat(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM read_parquet('{sf}/conversations.parquet')")
    want = con.execute(queries.ORACLE["op12_chat"]).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    text = "</s>[INST] ok [/INST]"
    odd = got[got["conv_id"] == -7].iloc[0]
    assert odd["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (odd["loss_chars"], odd["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())
