"""Transcripts parsed from raw text."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonarium.llm import chat
from sonarium.llm.language_id import fold

SF = "/root/testdata/sf0.01"


def _rendered(frame: pd.DataFrame) -> dict:
    frame = frame.sort_values(["piece", "n"])
    return {None if conv is pd.NA else conv: "".join(lines) for conv, lines in frame.fillna({"conv": "none"}).groupby("conv").rendered}


def test_pieces_do_not_matter_and_viterbi_is_best(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    long = spark.range(120).select(F.lit(99_999).cast("bigint").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
                                   F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("Some words here.\n\nAnd more of them").alias("text"))
    odd = spark.createDataFrame([(None, 0, None, None), (None, 1, "user", "hi?"), (None, 1, "user", "hi?"), (5, None, "x", "")],
                                "conv_id bigint, turn bigint, role string, text string").withColumn("symbol", F.lit(1))
    turns = turns.unionByName(long).unionByName(odd, allowMissingColumns=True)
    model = chat.train(chat.known_lines(turns))
    one = chat.transcripts(turns, parts=1)
    cut = chat.transcripts(turns, parts=7, piece_bytes=300)
    assert one.count() == turns.select("conv_id").distinct().count() < cut.count()
    got, many = chat.parse(one, model).toPandas(), chat.parse(cut, model).toPandas()
    assert len(got) == len(many) == chat.known_lines(turns).count()
    assert _rendered(got) == _rendered(many)

    symbols = np.array([0, 30, 5, 0, 60])
    def value(path):
        return model.start[path[0]] + model.emit[path, symbols].sum() + sum(model.step[a, b] for a, b in zip(path, path[1:]))
    best = max(value(list(p)) for p in itertools.product(range(chat.STATES), repeat=5))
    assert np.isclose(value(chat.viterbi(model, symbols, model.start)), best)
    assert chat.parse(one.where("false"), model).count() == 0 and chat.transcripts(turns.where("false")).count() == 0
    with pytest.raises(Exception, match="comes twice"):
        chat.parse(one.union(one), model).collect()


def test_raw_texts_without_pieces(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.train(chat.known_lines(turns.withColumn("text", F.regexp_replace("text", "\n", "\n\n"))).where("style < 3"))
    texts = [("a", "User: hi there\nAssistant: reply one\n\nreply two\nUser: thanks?"), ("b", None), (None, "Q: x\n\nA: y")]
    got = chat.parse(spark.createDataFrame(texts, "conv string, text string"), model).toPandas()
    turn = lambda role, text: f"{chat.OPEN}{role}\n{text}{chat.CLOSE}\n"
    want = turn("user", "hi there") + turn("assistant", "reply one\n\nreply two") + turn("user", "thanks?")
    assert "".join(got[got.conv == "a"].rendered) == want
    assert "".join(got[got.conv.isna()].rendered) == turn("user", "x") + turn("assistant", "y")
    assert len(got[got.conv == "b"]) == 1


def _held_out(spark, turns):
    """Roles and borders of the conversations held out, by style, against what their lines are."""
    held = fold(F.col("conv"), 4) == 2
    known = chat.known_lines(turns)
    model = chat.train(known.where(~held))
    got = chat.parse(chat.transcripts(turns).where(held), model).toPandas().sort_values(["conv", "piece", "n"]).reset_index(drop=True)
    truth = known.where(held).toPandas().sort_values(["conv", "turn", "n"]).reset_index(drop=True)
    assert len(got) == len(truth) and (got.conv == truth.conv).all()
    text = truth.kind != chat.GAP
    right = pd.DataFrame({"style": truth["style"], "role": (got.role == truth.role)[text], "border": (got.begins == (truth.kind == chat.BEGIN))})
    return right.astype({"border": float}).assign(role=right.role.astype(float)).groupby("style")[["role", "border"]].mean()


def test_recovers_roles_and_borders(spark):
    found = _held_out(spark, spark.read.parquet(f"{SF}/conversations.parquet"))
    print(found)
    assert len(found) == 4 and (found.border > 0.95).all()
    assert (found.role[:3] > 0.95).all() and found.role[3] > 0.7


def test_blank_lines_within_turns(spark):
    """Every other line feed of the texts becomes a blank line: borders must not follow blank lines alone."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    found = _held_out(spark, turns.withColumn("text", F.regexp_replace("text", r"\n([^\n]*)(\n|$)", "\n\n$1$2")))
    print(found)
    assert (found.border[:3] > 0.95).all() and (found.role[:3] > 0.95).all()
    assert found.border[3] > 0.6
