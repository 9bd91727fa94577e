from seedscape.llm import chat

TEMPLATE = chat.Template()


def text_of(turns):
    clean = lambda s: (s or "").replace("<|", "< |")
    return "".join(f"<|start|>{clean(r)}\n{clean(t)}<|end|>\n" for r, t in turns)


def spans_of(turns):
    out, at = [], 0
    for role, text in turns:
        head = len(text_of([(role, "")])) - len("<|end|>\n")
        whole = len(text_of([(role, text)]))
        if role == "assistant":
            out.append((at + head, at + whole))
        at += whole
    return out


PAIRS = [
    ([("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "b <|end|> 東京")]),
    ([("user", "hi")], [("user", "hi"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]),
    ([("user", "x")], [("user", "y")]),
    ([("user", "x"), ("assistant", "z")], [("user", "x"), ("assistant", "z")]),
    ([], [("assistant", "")]),
    (None, [("user", "y")]),
    (None, None),
    ([(None, "x"), ("user", None)], [("", "x"), ("user", ""), ("assistant", "é" * 500)]),
    ([("user", "x"), ("user", "x")], [("user", "x")]),
]


def test_equals_plain_rendering(spark):
    frame = spark.createDataFrame(
        [(i, c, r, "clash") for i, (c, r) in enumerate(PAIRS)],
        f"pair long, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>, prompt string",
    )
    rows = chat.format_preferences(frame).collect()
    assert len(rows) == len(PAIRS)
    for row in rows:
        chosen, rejected = ([(a or "", b or "") for a, b in side or []] for side in PAIRS[row.pair])
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        assert row.prompt_turns == n and row.prompt == text_of(chosen[:n])
        assert (row.chosen, row.rejected) == (text_of(chosen[n:]), text_of(rejected[n:]))
        for side, turns in (("chosen", chosen[n:]), ("rejected", rejected[n:])):
            spans = [(s.start, s.end) for s in row[f"{side}_trained"]]
            assert spans == spans_of(turns)
            assert all(row[side][a:b].endswith("<|end|>\n") for a, b in spans)


def test_pairs_from_conversations(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "r"), (1, 3, "assistant", "last"), (1, 4, "user", "bye"),
        (2, 0, "user", "q"), (2, 1, "assistant", "only"),
        (3, 0, "user", "q"),
        (4, 1, "assistant", "same"), (4, 2, "assistant", "same"),
        (None, 0, "user", "lost"), (5, None, None, None), (5, 0, "user", "q"), (5, 0, "user", "q"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {r.conv_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.pairs_by_last_reply(frame).collect()}
    history = [("user", "q"), ("assistant", "first"), ("user", "r")]
    assert found == {
        1: ([*history, ("assistant", "last")], [*history, ("assistant", "first")]),
        2: ([("user", "q"), ("assistant", "only")], [("user", "q")]),
        3: ([("user", "q")], [("user", "q")]),
        4: ([("assistant", "same")] * 2, [("assistant", "same")]),
        5: ([("", ""), ("user", "q"), ("user", "q")],) * 2,
        None: ([("user", "lost")], [("user", "lost")]),
    }
    closing = {r.conv_id: [tuple(t) for t in r.closing] for r in chat.pairs_by_last_reply(frame).collect()}
    assert closing == {1: [("user", "bye")], 2: [], 3: [], 4: [], 5: [], None: []}
    assert chat.format_preferences(chat.pairs_by_last_reply(frame.limit(0))).count() == 0


def test_rows_without_an_id_are_not_gathered(spark):
    """Each is a conversation of its own; other columns, of whatever name, take no part; a long conversation stays whole."""
    rows = [(None, i % 2, "assistant" if i % 2 else "user", f"t{i}") for i in range(50)] + [(1, i, "user", "x" * 100) for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'clash' AS t", "1 AS turns", "2 AS closing")
    found = chat.turns_of(frame)
    assert found.filter("conv_id is null and size(turns) = 1").count() == 50
    assert found.filter("conv_id = 1").selectExpr("size(turns)").first()[0] == 3000
