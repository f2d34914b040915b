"""Rows that operators put out between their steps follow the rows they read, however large a group of near copies is."""

import random

from test_edges import components_by_force, prose

from slotweave.llm import jaccard


def test_links_across_components_of_a_tile_are_not_put_out_in_pairs(spark, monkeypatch):
    """A tile of eight groups of forty copies that all link within a group: the pivot reaches its own group only."""
    r = random.Random(23)
    base = prose(r, 150, 100_000).split(" ")
    texts = []
    for k in range(320):
        at = 18 * (k % 8)
        texts.append(" ".join([*base[:at], *prose(r, 8, 100_000).split(" "), *base[at + 8 :]]))
    texts += [" ".join([*base[: 4 * k], *prose(r, 30, 100_000).split(" "), *base[4 * k + 30 :]]) for k in range(20)]  # link with nothing
    of, _ = components_by_force(texts, 5, 80, 100)
    assert len(set(of)) > 20 and max(of.count(k) for k in set(of)) == 40

    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    features = frame.mapInArrow(jaccard._features(5, 80, 100), "node long, n long, bits binary, shingles binary").cache()
    tiles = spark.createDataFrame([(t, 0, k) for t in (7, 9) for k in range(1, len(texts) - t)], "tile long, pivot long, node long")
    written = []

    def checkpoint(df, plain=jaccard.checkpoint):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "checkpoint", checkpoint)
    monkeypatch.setattr(jaccard, "drop_tables", lambda *tables: None)
    linked = {k for k in range(len(texts) - 7) if of.count(of[k]) > 1}
    entries = 2 * len(texts) - 16
    for tile, parts in ((jaccard.TILE, 1), (50, 7)):
        monkeypatch.setattr(jaccard, "TILE", tile)
        got = {row["node"]: row["component"] for row in jaccard._components(tiles, features, 80, 100).collect()}
        assert got == {k: of[k] for k in linked}
        assert max(written) <= parts * entries  # 6,240 pairs link
