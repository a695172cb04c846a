import hashlib

from pyspark.sql import functions as F

from feedspark.operators import framing as M


def _msgs(spark, texts, channel="c"):
    return spark.createDataFrame([(channel, i, t) for i, t in enumerate(texts)], "ch string, k bigint, t string")


def test_frame_counts_and_roundtrip(spark):
    texts = ["", "a", "b" * 1024, "c" * 1025, "d" * 2048, "é" * 700, "x" * 1023 + "€" + "y" * 10]
    fr = M.split_frames(_msgs(spark, texts), "ch", "k", "t")
    rows = fr.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    flags = [r.full_msg for r in rows]
    assert flags == [1, 1, 1, 0, 1, 0, 1, 0, 1, 0, 1]
    assert all(len(r.mtext) <= 1024 for r in rows)
    back = M.join_frames(fr).orderBy("msg_id").collect()
    assert [r.message for r in back] == texts
    assert [r.n_frames for r in back] == [1, 1, 1, 2, 2, 2, 2]


def test_other_frame_sizes_lose_nothing(spark):
    texts = ["x" * 1500, "", "é" * 511, "y" * 512]
    for size in (1, 7, 256, 512, 5000):
        fr = M.split_frames(_msgs(spark, texts), "ch", "k", "t", size=size)
        assert max(len(r.mtext) for r in fr.collect()) <= size
        assert [r.message for r in M.join_frames(fr).orderBy("msg_id").collect()] == texts


def test_tail_without_flag_is_held_back(spark):
    fr = M.split_frames(_msgs(spark, ["a" * 10, "b" * 3000]), "ch", "k", "t")
    cut = fr.where(F.col("pos") < 3)  # the closing frame of the second message has not arrived
    done = M.join_frames(cut).collect()
    assert [r.message for r in done] == ["a" * 10]
    pend = M.pending_frames(cut).orderBy("pos").collect()
    assert [r.pos for r in pend] == [1, 2]
    st = M.frame_state(cut).first()
    assert (st.complete_msgs, st.pending_frames, st.pending_bytes) == (1, 2, 2048)


def test_documents_roundtrip(spark):
    from conftest import SF001

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    fr = M.split_frames(docs, "lang", "doc_id", "text")
    got = {(r.channel, r.msg_id): r.message for r in M.join_frames(fr).collect()}
    want = docs.orderBy("doc_id").collect()
    seen = {}
    for d in want:
        i = seen.get(d.lang, 0)
        seen[d.lang] = i + 1
        assert hashlib.md5(got[(d.lang, i)].encode()).hexdigest() == hashlib.md5(d.text.encode()).hexdigest()
