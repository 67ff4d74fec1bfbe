"""Published label x group counts of the reference workload (fixed values)."""

GROUPS = ["GSM2230757", "GSM2230758", "GSM2230759", "GSM2230760"]
COUNTS = {
    "acinar": [110, 3, 843, 2],
    "activated_stellate": [51, 81, 100, 52],
    "alpha": [236, 676, 1130, 284],
    "beta": [872, 371, 787, 495],
    "delta": [214, 125, 161, 101],
    "ductal": [120, 301, 376, 280],
    "endothelial": [130, 23, 92, 7],
    "epsilon": [13, 2, 2, 1],
    "gamma": [70, 86, 36, 63],
    "macrophage": [14, 17, 14, 10],
    "mast": [8, 9, 7, 1],
    "quiescent_stellate": [92, 22, 54, 5],
    "schwann": [5, 6, 1, 1],
    "t_cell": [2, 2, 2, 1],
}
TEST_SIZES = {
    "acinar": 144, "activated_stellate": 42, "alpha": 349, "beta": 379, "delta": 90, "ductal": 161,
    "endothelial": 38, "gamma": 38, "macrophage": 8, "quiescent_stellate": 26,
}


def entities(spark):
    rows, i = [], 0
    for label, counts in COUNTS.items():
        for grp, n in zip(GROUPS, counts):
            for _ in range(n):
                rows.append((f"cell{i:05d}", label, grp))
                i += 1
    return spark.createDataFrame(rows, "entity_id string, label string, grp string")
