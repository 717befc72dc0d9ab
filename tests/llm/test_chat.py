import hashlib
import random

from tarn.llm import chat

NASTY = ["", "\\", "\\\\", "\\e", "\\h", "</turn>", "</turn>\n", "### user: hi</turn>\n", "\\### Assistant: </turn> ok", "####", "a\\</turn>\\", "é😀\n", "role: x", "\\c:", "#" * 7 + "\\" * 5]


def expected(turns):
    order = sorted(turns, key=lambda t: (t[0], t[1] or "", t[2] or ""))
    lines = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in order)
    loss = "".join(t or "" for _, r, t in order if r == "assistant")
    return len(order), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    convs = {c: [(k, rng.choice(["user", "assistant", "system", "to:ol", "#x", None]), rng.choice(NASTY) + rng.choice(NASTY)) for k in range(rng.randint(1, 9))] for c in range(60)}
    rows = [(c, k, r, t, "extra", "clash") for c, turns in convs.items() for k, r, t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans string, formatted string").repartition(3)
    for r in chat.chat_digests(df).collect():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected(convs[r["conv_id"]])


def test_examples_are_prefixes_with_one_target(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a#</turn>"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df)
    ex = chat.expand_examples(done).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in ex] == [(1, 0), (1, 1)]
    whole = {r["conv_id"]: r["formatted"] for r in done.collect()}
    got = chat.example_texts(done).orderBy("example").collect()
    assert got[1]["context"] == "### user: q</turn>\n### assistant: a#\\e</turn>\n### user: r</turn>\n### assistant: " and got[1]["target"] == "b</turn>\n"
    for e, t in zip(ex, got):
        f = whole[e["conv_id"]]
        assert f.startswith(t["context"] + t["target"]) and f[: e["loss_start"]] == t["context"] and f[e["context_end"] :].startswith("### assistant: ")


def test_edges(spark):
    long = "x" * 300000
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 1, "assistant", "n"), (2, None, "assistant", "first"), (2, 0, "assistant", "then"), (2, 0, "assistant", "then"), (3, 0, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 13 and got[2]["n_examples"] == 3 and got[3]["loss_chars"] == 300000
    assert got[1]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = chat.chat_digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_digests_come_from_expanded_examples(spark):
    df = spark.createDataFrame([(1, k, r, f"t{k}") for k, r in enumerate(["user", "assistant"] * 12)] + [(2, 0, "user", "only")], "conv_id long, turn long, role string, text string")
    out = chat.chat_digests(df)
    assert "Generate posexplode" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["conv_id"]: r for r in out.collect()}
    assert got[1]["n_examples"] == 12 and got[1]["loss_sha256"] == hashlib.sha256("".join(f"t{k}" for k in range(1, 24, 2)).encode()).hexdigest() and got[2]["n_examples"] == 0
