"""The plausibility model: Markov logic, a bilinear scorer, calibration, its life cycle."""
