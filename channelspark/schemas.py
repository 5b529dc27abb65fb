"""Logical tables: column names, types and units, plus the selectable output products."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract version and the selectable products.
SCHEMA_VERSION = "2.3.0"
PRODUCTS = (
    "derived", "cfr_truth", "cir_truth", "path_samples", "nlos_path_truth", "link_labels",
    "path_full", "cfr_obs", "array", "ranging", "iq", "multiuser", "calibration", "motion",
    "visualization",
)
PRODUCT_ALIASES = {
    "cfr_observation": "cfr_obs",
    "observation": "cfr_obs",
    "obs": "cfr_obs",
    "rtt": "ranging",
    "range": "ranging",
    "spectrum": "array",
    "spatial_spectrum": "array",
    "paths": "path_samples",
    "full_paths": "path_full",
    "labels": "link_labels",
    "link_label": "link_labels",
    "rt_labels": "link_labels",
}


def _table(**columns) -> T.StructType:
    fields = []
    for name, spec in columns.items():
        dtype, unit = spec if isinstance(spec, tuple) else (spec, None)
        meta = {"unit": unit} if unit else {}
        fields.append(T.StructField(name, dtype, True, meta))
    return T.StructType(fields)


STR, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DBL, BOOL, TS = T.DoubleType(), T.BooleanType(), T.TimestampType()
XYZ = T.StructType([T.StructField(n, DBL) for n in "xyz"])
COMPLEX = T.StructType([T.StructField(n, DBL) for n in ("re", "im")])

POINTS = _table(scene_id=LONG, role=STR, idx=LONG, x=(DBL, "m"), y=(DBL, "m"), z=(DBL, "m"),
                label=STR)
LINKS = _table(scene_id=LONG, tx=LONG, rx=LONG, link_index=LONG, valid=BOOL,
               distance_m=(DBL, "m"), distance_2d_m=(DBL, "m"), bearing_rad=(DBL, "rad"),
               power_db=(DBL, "dB"))
PATHS = _table(tx=LONG, rx=LONG, rx_ant=INT, tx_ant=INT, path=LONG, a_re=DBL, a_im=DBL,
               tau_s=(DBL, "s"), doppler_hz=(DBL, "Hz"), theta_t=(DBL, "rad"),
               phi_t=(DBL, "rad"), theta_r=(DBL, "rad"), phi_r=(DBL, "rad"),
               interactions=T.ArrayType(INT), vertices=T.ArrayType(XYZ))
CFR = _table(tx=LONG, rx=LONG, rx_ant=LONG, h=T.ArrayType(COMPLEX))
RSS = _table(ue=LONG, bs=LONG, rssi_dbm=(DBL, "dBm"), valid=BOOL)
RANGING = _table(estimator=STR, tx=LONG, rx=LONG, toa_s=(DBL, "s"), range_m=(DBL, "m"),
                 rtt_s=(DBL, "s"), error_m=(DBL, "m"), success=BOOL)
EVALUATION = _table(tx=LONG, rx=LONG, nmse_db=(DBL, "dB"), amp_err_db=(DBL, "dB"),
                    phase_err_rad=(DBL, "rad"), corr=DBL, valid=BOOL)
SHARDS = _table(run_id=STR, shard_id=STR, shard_index=INT, fallback_level=INT, path=STR,
                ue_indices=T.ArrayType(LONG), bs_indices=T.ArrayType(LONG))
PERF_EVENTS = _table(event_id=LONG, ts=TS, worker=LONG, stage=STR, duration_s=(DBL, "s"),
                     raw_bytes=(LONG, "B"), storage_bytes=(LONG, "B"))
HW_SAMPLES = _table(ts=TS, worker=LONG, rss_mb=STR, gpu_mem_mb=STR, gpu_util=STR, threads=STR)
QUEUE_LOG = _table(entity=LONG, seq=LONG, ts=TS, status=STR)
SCENES = _table(scene_key=STR, scene_class=STR, source_scene_index=LONG, bs_count=LONG,
                ue_count=LONG, link_count=LONG)

#: Columns each product adds to the link keys of the wide link table.
PRODUCT_COLUMNS: dict[str, tuple[str, ...]] = {
    "derived": ("distance_m", "distance_2d_m", "bearing_rad"),
    "link_labels": ("first_delay_s", "strongest_delay_s", "los_distance_m", "power_db",
                    "path_count", "los_exists", "nlos_exists"),
    "cfr_truth": ("h",),
    "cir_truth": ("a_re", "a_im", "tau_s"),
    "path_samples": ("path", "tau_s", "path_type", "depth"),
    "nlos_path_truth": ("nlos_tau_s", "nlos_power_db"),
    "path_full": ("path", "a_re", "a_im", "tau_s", "doppler_hz", "theta_t", "phi_t", "theta_r",
                  "phi_r"),
    "cfr_obs": ("h_est", "nmse_db", "snr_db"),
    "array": ("spectrum",),
    "ranging": ("toa_s", "range_m", "rtt_s", "error_m", "success"),
    "iq": ("iq",),
    "multiuser": ("frame", "slot"),
    "calibration": ("phase_offset_rad",),
    "motion": ("snapshot", "timestamp_s"),
    "visualization": ("x_mid_m", "y_mid_m"),
}
