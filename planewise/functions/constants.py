"""Fixed values that are part of the semantics; every one is a default argument somewhere."""

THIN_MAX, DEEP_MIN = 2, 6
JITTER_CUTOFF, SWAY_CUTOFF = 1.75, 3.0
AREA_FLOOR, SLIVER_FRAC = 20, 0.05
CUTOFF_QUANTILE, OVERLAP_QUANTILE = 0.9, 0.5
FLOAT_BINS, MAX_EXACT_BINS = 4096, 2**17
DISPLAY_BINS, CLIP_QUANTILE = 60, 0.999
BRIGHTNESS_CUTOFF, CHANGE_CUTOFF, LAYER_SPAN_CUTOFF = 7000.0, 1.0, 1
SCORE_WEIGHTS = {"Span": 0.10, "Jitter": 0.50, "Sway": 0.10, "Signal": 0.30}
#: Which way is better: 1 more, -1 less, 0 neither.
POLARITY = {
    "n_masks": 0, "pct_thin": -1, "pct_deep": -1, "pct_z_gap": -1, "median_z_span": 0, "max_z_span": -1,
    "n_with_jitter": 0, "median_jitter": -1, "p90_jitter": -1, "pct_jittery": -1, "median_reversals": -1,
    "median_sway": -1, "p90_sway": -1, "pct_swayed": -1, "n_dropped": 0, "pct_dropped": 0,
    "separability": 1, "frac_masked": 0, "median_shift_iqr": 1, "mean_masked": 0, "mean_unmasked": 0,
    "dim_masked_rate": -1, "bright_unmasked_rate": -1, "Span": 1, "Jitter": 1, "Sway": 1, "Signal": 1, "Total": 1,
}
