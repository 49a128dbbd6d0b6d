import random

import pytest

from archivolt.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
CHAT = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> How  are YOU?\nFine."), (1, 2, "user", "Other topic"),
    (1, 3, "user", "> > how are you?\n> Fine.\nGood to hear"), (1, 4, "assistant", ">Other topic\nyes\n> unknown line"),
    (2, 0, "user", None), (None, 3, "x", "> hi"), (3, None, "x", "hi"), (2, 1, "user", "> nothing\nabc"), (1, 5, "user", ">>> how are you?\n>> fine.\n> Good to hear\nok"),
    (4, 0, "user", "twice"), (4, 0, "user", "twice"), (4, 1, "user", "> twice"), (4, 2, "user", ">   \n>\n"), (5, 0, "user", "w " * 100000 + "\nend"), (5, 1, "user", "> end\n" + "v " * 100000),
]


@pytest.fixture()
def chats(frame):
    return lambda rows: frame(rows, SCHEMA, extra=("row", "path", "line", "level", "key", "gone"))


def test_links_texts_and_order(chats):
    got = {(r.conv_id, r.turn): r for r in quotes.format_chats(chats(CHAT)).collect()}
    assert {k: (r.reply_to, r.n_quoted) for k, r in got.items()} == {
        (1, 0): (None, 0), (1, 1): (0, 1), (1, 2): (None, 0), (1, 3): (1, 2), (1, 4): (2, 1), (1, 5): (3, 3), (2, 0): (None, 0), (2, 1): (None, 0), (None, 3): (None, 0),
        (3, None): (None, 0), (4, 0): (None, 0), (4, 1): (0, 1), (4, 2): (None, 0), (5, 0): (None, 0), (5, 1): (0, 1)}
    assert [got[k].text for k in [(1, 1), (1, 3), (1, 4), (2, 0), (4, 1)]] == ["Fine.", "Good to hear", "yes\n> unknown line", "", ""]
    assert [r.turn for r in quotes.reply_order(quotes.format_chats(chats(CHAT))).collect() if r.conv_id == 1] == [0, 1, 3, 5, 2, 4]
    assert got[1, 5].depth == 3 and got[3, None].path == []
    assert len(quotes.format_chats(chats(CHAT)).collect()) == len(CHAT)


def test_against_a_plain_reading(chats):
    draw = random.Random(6)
    rows, said = [], {}
    for conv in range(6):
        for turn in range(40):
            own = [draw.choice("abcdefghijklmnop") * 3 for _ in range(draw.randrange(1, 4))]
            quoted = [draw.choice(said[conv])] if said.get(conv) and draw.random() < 0.6 else []
            rows.append((conv, turn, "user", "\n".join(["> " + q for q in quoted] + own)))
            said.setdefault(conv, []).extend(own)
    want, last = {}, {}
    for conv, turn, _, text in rows:
        head = text.split("\n")[0]
        want[conv, turn] = last.get((conv, head[2:])) if head.startswith("> ") else None
        for line in text.split("\n"):
            if not line.startswith(">"):
                last[conv, line] = turn
    got = {(r.conv_id, r.turn): r for r in quotes.format_chats(chats(rows)).collect()}
    assert {k: r.reply_to for k, r in got.items()} == want
    for k, r in got.items():
        path = [k[1]]
        while want[k[0], path[0]] is not None:
            path.insert(0, want[k[0], path[0]])
        assert r.path == path


def test_no_messages(chats):
    assert quotes.format_chats(chats([])).collect() == []
