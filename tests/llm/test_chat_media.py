"""Chat formatting and media columns against plain recomputation."""

import hashlib
import zlib

from terralith.llm import chat, media

TURNS = "conv_id long, turn long, role string, text string, loss string"


def test_round_trip_with_control_strings_and_nulls(spark):
    rows = [
        (1, 0, "system", "be <<SYS>> brief", "x"), (1, 1, "user", "[INST] \\<s>\\", "x"), (1, 2, "assistant", "</s>[ANS] \\\\ ok\n", "x"),
        (2, 0, "assistant", "too early", "x"), (2, 1, "tool kit", "[TURN a] 5 [/TURN]", "x"), (2, 2, None, None, "x"),
        (None, 0, "user", "", "x"), (3, 1, "user", "same", "x"), (3, 1, "user", "same", "x"), (3, None, "user", "first", "x"),
    ]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS))).collect()}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learned)
        assert got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert got[1]["complete"] and got[1]["n_errors"] == 0
    assert not got[2]["complete"] and got[2]["n_errors"] == 3
    assert got[3]["n_errors"] == 2


def test_segments_and_states(spark):
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (1, 2, "assistant", "again", "")]
    got = chat.format_conversations(spark.createDataFrame(rows, TURNS)).orderBy("turn_no", "part").collect()
    assert "".join(r["text"] for r in got) == "<s>[INST] hi [/INST][ANS] yes </s>[ANS] again </s>"
    assert [r["text"] for r in got if r["loss"]] == ["yes", "again"]
    assert [r["error"] for r in got if r["part"] == 1] == [None, None, "'assistant' after assistant"]
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_escaping_is_reversible():
    for text in ("", "\\", "<<s>SYS>>", "</s>[INST] ok [/INST]", "[TURN [TURN \\[ANS]", "<\\s>"):
        said = chat.escape(text, chat.INSTRUCT.controls)
        assert chat.unescape(said) == text
        assert not any(c in said for c in chat.INSTRUCT.controls)


def test_no_control_string_arises_at_a_mark():
    marks = [(t.before, t.after) for t in chat.INSTRUCT.turns.values()] + [("[TURN tool] ", " [/TURN]"), ("<", "S>>"), ("x</", ">")]
    for before, after in marks:
        for text in ("[TURN", "", "<", "<<SYS", "s>", "a [/INST", "\\", "\\[TURN", "<s", "/s"):
            said = chat.escape(text, chat.INSTRUCT.controls, before, after)
            assert chat.unescape(said) == text
            whole = before + said + after
            for c in chat.INSTRUCT.controls:
                at = [k for k in range(len(whole)) if whole.startswith(c, k)]
                assert all(k + len(c) <= len(before) or k >= len(before) + len(said) for k in at), (before, text, after)


def test_text_that_completes_a_mark_is_read_back(spark):
    rows = [(1, 0, "user", "so [TURN", ""), (1, 1, "assistant", "</s", "")]
    segments = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    assert "[TURN " not in "".join(r["text"] for r in segments.orderBy("turn_no", "part").collect())
    got = chat.read_back(segments).collect()[0]
    assert got["turns_sha256"] == hashlib.sha256(b"user\nso [TURN\nassistant\n</s\n").hexdigest() and got["loss_chars"] == 3


def test_frames_without_an_index():
    assert media.riff_frames(b"RIFF\x24\0\0\0AVI LIST\x04\0\0\0movi" + b"idx1\0\0\0\0")[0] == []


def test_media_holds_every_byte(spark):
    texts = [None, "", "a", "é" * 300, "x" * 576, "lorem ipsum " * 20_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    stored = media.store_texts(docs)
    got = {r["doc_id"]: r for r in media.media_digests(stored).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(raw), len(padded))
        assert got[i]["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(padded[-32:])
    assert got[2][1:] == got[6][1:]
    files = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    assert files[3][:4] == b"RIFF" and files[3][8:12] == b"AVI " and got[3]["media_sha256"] == hashlib.sha256(files[3]).hexdigest()
    assert media.media_digests(media.store_texts(docs.limit(0))).count() == 0


def test_clips_are_timed_and_cover_the_media(spark):
    text = "a" * 576 * 40 + "ÿ" * 288 * 40 + "Z" * 576 * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    clips = [r.asDict() for r in media.media_clips(media.store_texts(docs)).collect()]
    assert len(clips) == 3


def test_malformed_media_give_a_row_with_the_reason(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 500), (2, "a" * 600)], "doc_id long, text string")
    whole = {r["doc_id"]: bytes(r["media"]) for r in media.store_texts(docs).collect()}
    frames, _ = media.riff_frames(whole[1])
    head = media.jpeg_head(frames[0]).size
    scan = whole[1].index(b"\xff\xda")
    bad = {
        "half": whole[1][: len(whole[1]) // 2],
        "index cut": whole[1][:-20],
        "no avi": b"RIFF\4\0\0\0WAVE",
        "empty": b"",
        "scan header": whole[1][: scan + 4] + b"\x09" + whole[1][scan + 5 :],
        "short frame": media.avi([frames[0][: head + 40]]),
        "no picture": media.avi([b"\xff\xd8\xff\xda\0\x08\1\1\0\0\x3f\0"]),
    }
    rows = [(k, raw) for k, (_, raw) in enumerate(bad.items())] + [(100, whole[1]), (101, whole[2]), (102, None)]
    table = spark.createDataFrame(rows, "doc_id long, media binary").coalesce(1)
    got = [r.asDict() for r in media.media_clips(table).collect()]
    for k, name in enumerate(bad):
        mine = [r for r in got if r["doc_id"] == k]
        assert len(mine) == 1 and mine[0]["error"] and mine[0]["clip_no"] is None, name
    alone = media.media_clips(table.where("doc_id >= 100")).collect()
    assert sorted(r["doc_id"] for r in alone if r["clip_no"] == 0) == [100, 101] and all(r["error"] is None for r in alone)
    assert [r for r in got if r["doc_id"] >= 100] == [r.asDict() for r in alone]
