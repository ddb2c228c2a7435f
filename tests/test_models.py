"""Clusters, components and importances against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from debatelens.operators import cluster
from debatelens.operators.normalize import main_bots
from debatelens.plans.catalog import signed_bots


@pytest.fixture(scope="module")
def bots(msgs):
    return signed_bots(msgs)


def matrix(rows):
    return np.array([[r[c] for c in cluster.SCORES] for r in rows])


def test_components_equal_numpy_up_to_sign(bots):
    rows = cluster.project_scores(bots).orderBy("id").collect()
    data = matrix(rows)
    centred = data - data.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for i, name in enumerate(["pc1", "pc2"]):
        ours, theirs = np.array([r[name] for r in rows]), centred @ axes[i]
        assert np.allclose(ours, theirs) or np.allclose(ours, -theirs)


def test_every_row_is_in_its_nearest_cluster(bots):
    vectors = cluster.score_vectors(bots)
    model = cluster.fit_clusters(vectors)
    rows = model.transform(vectors).collect()
    centres = np.array(model.clusterCenters())
    assert len(centres) == 3
    nearest = ((matrix(rows)[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert [r["cluster"] for r in rows] == nearest.tolist()


def test_sample_gets_the_clusters_of_the_whole(bots):
    whole = {r["id"]: r["cluster"] for r in cluster.cluster_scores(bots).collect()}
    sample = cluster.seeded_sample(bots.na.drop(subset=cluster.SCORES), 5)
    assigned = cluster.assign_clusters(bots, sample).collect()
    assert len(assigned) == 5 and all(whole[r["id"]] == r["cluster"] for r in assigned)


def test_importances_sum_to_one(bots):
    rows = cluster.feature_importance(bots, trees=5).collect()
    assert {r["feature"] for r in rows} == set(cluster.SCORES)
    assert sum(r["importance"] for r in rows) == pytest.approx(1)


def test_main_rows_are_plain_bots(msgs):
    rows = main_bots(msgs).select(F.collect_set("speaker"), F.collect_set("api")).first()
    assert set(rows[0]) == {"Bot 1", "Bot 2"} and rows[1] == ["openai"]
