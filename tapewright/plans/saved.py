"""Small models that were fitted once on the hourly bars of sf0.01, to six digits, for queries that apply a saved model.

``TwoStage.from_json`` reads them; ``oracles`` writes their SQL from the same text.
"""

LINEAR = """{
    "first": {"kind": "Linear", "columns": ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"], "coefficients": [-0.311998, -0.534806, -0.0175938, 0.124131, -0.0467792, -0.195187], "intercept": -0.108295},
    "second": {"kind": "Linear", "columns": ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"], "coefficients": [-2.03539, -0.0415123, -0.0536665, -0.12261, -0.308503, 0.145584], "intercept": -0.419037},
    "scaler": {"r_t": [0.000456799, 1.18988], "sigma_hat": [1.13677, 0.281309], "OFI_t": [0.123742, 101.153], "Imbalance_t": [-0.00520272, 0.737977], "VolSpike_t": [0.995029, 0.608732], "msg_count": [2.96012, 1.52611]}}"""

BOOSTED = """{
    "first": {"kind": "Trees", "columns": ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"], "depth": 3, "link": "log_odds", "trees": [
        {"f": [0, 5, 3, -1, 5, 5, 0], "t": [-0.996523, -0.629129, -0.279229, 0.0, 0.0261323, -0.629129, 1.87318], "m": [false, false, false, true, false, false, false], "v": [0.1, 0.0, 0.0371387, -0.0202533, -0.018005, -0.0556368, -0.00318332, -0.0788235]},
        {"f": [1, 1, 0, 4, 0, 4, 0], "t": [-0.407706, -1.14634, -1.18674, 0.407595, -0.815387, -0.280436, 0.173777], "m": [false, false, false, false, false, false, false], "v": [0.1, 0.0420826, 0.1, 0.0134767, 0.1, -0.0230937, -0.0818086, -0.031892]},
        {"f": [0, 4, 1, -1, 1, 1, 1], "t": [-0.996523, -0.280436, -0.654619, 0.0, -0.27601, -1.14634, 0.651828], "m": [false, false, false, true, false, false, false], "v": [0.1, 0.0, 0.0595558, -0.0286131, 0.0976549, 0.0212893, -0.0341233, -0.0962078]}]},
    "second": {"kind": "Trees", "columns": ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"], "depth": 3, "link": "log_odds", "trees": [
        {"f": [0, 0, 0, -1, 4, -1, -1], "t": [-0.170848, -0.633991, 0.070639, 0.0, 0.0191183, 0.0, 0.0], "m": [false, false, false, true, false, true, true], "v": [0.1, 0.0, -0.00470244, 0.0424407, -0.0158845, 0.0, -0.1, 0.0]},
        {"f": [5, 1, 3, 2, -1, -1, 1], "t": [-0.629129, -0.21379, -0.908528, 0.453535, 0.0, 0.0, -1.00694], "m": [false, false, false, false, true, true, false], "v": [0.00917875, -0.0450166, 0.0647586, 0.0, 0.014001, 0.0, -0.00535257, -0.057155]},
        {"f": [0, 0, 0, -1, -1, -1, -1], "t": [-0.170848, -0.546209, 0.029328, 0.0, 0.0, 0.0, 0.0], "m": [false, false, false, true, true, true, true], "v": [0.1, 0.0, 0.00892886, 0.0, -0.00150186, 0.0, -0.1, 0.0]}]},
    "scaler": {"r_t": [0.000456799, 1.18988], "sigma_hat": [1.13677, 0.281309], "OFI_t": [0.123742, 101.153], "Imbalance_t": [-0.00520272, 0.737977], "VolSpike_t": [0.995029, 0.608732], "msg_count": [2.96012, 1.52611]}}"""

FOREST = """{
    "columns": ["r_t", "sigma_hat", "OFI_t", "Imbalance_t", "VolSpike_t", "msg_count"], "depth": 4, "usual": 4.69553, "trees": [
        {"f": [5, 3, 2, 5, 0, 3, -1, 1, 5, 0, -1, -1, -1, -1, -1], "t": [4.58886, 0.551371, -82.742, 1.60033, 1.03898, -0.54041, 0.0, 1.07156, 2.82123, -0.521157, 0.0, 0.0, 0.0, 0.0, 0.0], "m": [true, true, true, true, true, true, true, true, true, true, true, true, true, true, true], "v": [4.0, 4.0, 5.20739, 4.0, 4.0, 6.32702, 3.0, 0.0, 3.0, 0.0, 3.0, 0.0, 2.0, 0.0, 0.0, 0.0]},
        {"f": [4, 1, -1, 3, 2, -1, -1, 4, 3, -1, 3, -1, -1, -1, -1], "t": [1.93004, 0.998049, 0.0, 0.739793, -18.6199, 0.0, 0.0, 0.695423, 1.0, 0.0, -0.517296, 0.0, 0.0, 0.0, 0.0], "m": [true, true, true, true, true, true, true, true, true, true, true, true, true, true, true], "v": [4.0, 5.0, 4.0, 4.0, 3.0, 0.0, 4.0, 7.29625, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]},
        {"f": [2, 5, 5, 4, -1, 5, -1, 4, -1, -1, -1, -1, 4, -1, -1], "t": [-23.9857, 4.01574, 6.50943, 0.767593, 0.0, 1.13294, 0.0, 0.689592, 0.0, 0.0, 0.0, 0.0, 1.66799, 0.0, 0.0], "m": [true, true, true, true, true, true, true, true, true, true, true, true, true, true, true], "v": [5.20739, 4.0, 3.0, 0.0, 2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 6.70664, 5.0, 2.0, 0.0, 0.0, 0.0]},
        {"f": [4, 5, 0, -1, 2, 2, 4, -1, -1, -1, -1, -1, -1, 3, 5], "t": [0.650798, 1.82844, -0.970342, 0.0, 27.2305, 7.52524, 1.38312, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.650666, 5.01465], "m": [true, true, true, true, true, true, true, true, true, true, true, true, true, true, true], "v": [2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 3.0, 0.0, 3.0, 0.0, 3.0, 0.0, 5.85166, 5.85166, 4.0, 5.0]}]}"""
