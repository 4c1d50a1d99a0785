import hashlib
import random

import pytest

from quillspark.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def rows():
    rnd = random.Random(3)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "\\", "<", "|", "\n", "word ", "é🙂", "$1", "\\|", "<\\|", " "]
    text = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 60)))
    out = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    for c in range(25):
        out += [(c, 0, "system" if c % 2 else "user", text())]
        out += [(c, t, rnd.choice(["user", "assistant", "tool", "system"]), text()) for t in range(1, rnd.choice([1, 2, 9, 80]))]
    out += [(99, t, "user" if t % 2 else "assistant", text()) for t in range(700)]
    out += [(50, 1, None, None), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, None, "a\nb<|\\", "x"), (None, 2, "user", "q"), (None, 1, "assistant", "a"), (51, 0, "assistant", "w " * 2000)]
    # Many turns of one number, and without one; repeated rows among them; turns of other numbers beside.
    out += [(60, None, rnd.choice(["user", "assistant"]), text()) for _ in range(400)] + [(60, 3, "assistant", "same")] * 300 + [(60, t, "user", text()) for t in (2, 3, 4, 300)]
    out += [(61, 700, "assistant", text()) for _ in range(300)] + [(61, t, "assistant", text()) for t in (0, 699, 701)]
    return out


@pytest.mark.parametrize("options", [{}, {"budget": 60, "history_turns": 3, "history_tokens": 20, "system_tokens": 10}, {"history_turns": 0}])
def test_round_trip_by_brute_force(spark, options):
    df = spark.createDataFrame([(*r, 1) for r in rows()], "conv_id long, turn long, role string, text string, block int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.written_report(df, **options).collect()}
    assert got == brute(rows())


def test_windows_keep_budget_system_and_history(spark):
    say = lambda n: " ".join(["w"] * n)
    data = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", f"t{t} {say(15)}") for t in range(1, 60)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = sorted(chat.format_windows(df, budget=200, history_turns=2, history_tokens=50, system_tokens=10).collect(), key=lambda r: (r.block, r.span))
    assert len(windows) > 3
    for k, w in enumerate(windows):
        turns = w.text.split(chat.START)[1:]
        assert len(w.text.split()) + 4 * len(turns) <= 230
        assert turns[0].startswith("system\nbe kind")
        assert w.n_context == (3 if k else 0)
        new = "".join(turns[w.n_context :])
        for s in w.loss_spans:
            part = w.text[s.start : s.start + s.length]
            assert part in new and w.text[: s.start].endswith("assistant\n") and w.text[s.start + s.length :].startswith(chat.END)
        assert len(w.loss_spans) == new.count("assistant\n")


def test_blocks_are_bounded(spark):
    df = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "struct(role, text as body) as t")
    found = {}
    for r in chat.blocks(df).collect():
        found.setdefault((r.conv_id, tuple(r.block)), []).append(r.turn)
    assert max(map(len, found.values())) <= chat.BLOCK_TURNS and sum(map(len, found.values())) == len(rows())


def test_tokens_from_a_column(spark):
    data = [(1, t, "assistant", "word", 50) for t in range(20)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, n int")
    assert chat.format_windows(df, tokens="n").count() > chat.format_windows(df).count()


def test_estimate_is_an_upper_one(spark):
    from tokenizers import Tokenizer

    from quillspark.llm.queries import tokenizer_file

    said = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_file(name))
        over = [t for t in said if len(library.encode(t, add_special_tokens=False).ids) > chat.TOKENS_A_BYTE * len(t.encode()) + chat.TURN_TOKENS]
        assert not over


def test_empty_table(spark):
    assert chat.written_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
