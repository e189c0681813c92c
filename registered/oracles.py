"""DuckDB side: the same results in SQL, from the driver's tables."""

from __future__ import annotations

# The published filter taps of the biorthogonal 6.8 wavelet, padded to 18.
DEC_LO = (
    0.0, 0.0019088317364812906, -0.0019142861290887667,
    -0.016990639867602342, 0.01193456527972926, 0.04973290349094079,
    -0.07726317316720414, -0.09405920349573646, 0.4207962846098268,
    0.8259229974584023, 0.4207962846098268, -0.09405920349573646,
    -0.07726317316720414, 0.04973290349094079, 0.01193456527972926,
    -0.016990639867602342, -0.0019142861290887667, 0.0019088317364812906,
)
DEC_HI = (
    -0.0, 0.0, -0.0,
    0.014426282505624435, -0.014467504896790148, -0.07872200106262882,
    0.04036797903033992, 0.41784910915027457, -0.7589077294536541,
    0.41784910915027457, 0.04036797903033992, -0.07872200106262882,
    -0.014467504896790148, 0.014426282505624435, -0.0,
    0.0, -0.0, 0.0,
)
REC_LO = (
    0.0, 0.0, 0.0,
    0.014426282505624435, 0.014467504896790148, -0.07872200106262882,
    -0.04036797903033992, 0.41784910915027457, 0.7589077294536541,
    0.41784910915027457, -0.04036797903033992, -0.07872200106262882,
    0.014467504896790148, 0.014426282505624435, 0.0,
    0.0, 0.0, 0.0,
)
REC_HI = (
    0.0, -0.0019088317364812906, -0.0019142861290887667,
    0.016990639867602342, 0.01193456527972926, -0.04973290349094079,
    -0.07726317316720414, 0.09405920349573646, 0.4207962846098268,
    -0.8259229974584023, 0.4207962846098268, 0.09405920349573646,
    -0.07726317316720414, -0.04973290349094079, 0.01193456527972926,
    0.016990639867602342, -0.0019142861290887667, -0.0019088317364812906,
)


def taps(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def rounded(expression: str) -> str:
    return f"round(({expression})::DOUBLE, 6) + 0.0"


def ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts)


# A relation with columns (key columns, x DOUBLE[]) is the input of all wavelet SQL.
VECTORS = "SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings"

LEADS = """SELECT vec_id // 12 AS patient_id, CAST(vec_id % 12 AS INTEGER) AS lead_idx,
  'lead_' || (vec_id % 12) AS lead, 8.0::DOUBLE AS fs, embedding::DOUBLE[] AS x FROM embeddings"""

META = """SELECT vec_id // 12 AS patient_id, arg_min(label, vec_id) AS brugada
  FROM embeddings GROUP BY 1"""

LABELS = f"""SELECT patient_id, CASE WHEN brugada > 0 THEN 1 ELSE 0 END AS label
  FROM ({META})"""

INDEXED = """SELECT event_id, user_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events"""


def analysis(source: str, signal: str, low: str, high: str) -> str:
    """One level of the forward transform of list column ``signal``."""

    def band(filter_taps) -> str:
        at = f"(2 * k + 1 - j + 64 * len({signal})) % (2 * len({signal}))"
        value = (
            f"{signal}[CASE WHEN {at} < len({signal}) THEN {at} + 1 "
            f"ELSE 2 * len({signal}) - {at} END]"
        )
        return (
            f"list_transform(range(0, (len({signal}) + 17) // 2), lambda k: "
            f"list_sum(list_transform(range(0, 18), lambda j: "
            f"({taps(filter_taps)})[j + 1] * {value})))"
        )

    return f"SELECT *, {band(DEC_LO)} AS {low}, {band(DEC_HI)} AS {high} FROM {source}"


def synthesis(source: str, low: str, high: str, out: str) -> str:
    """One level of the inverse transform."""
    tap = "16 + m % 2 - 2 * r + 1"
    term = (
        f"{low}[m // 2 + r + 1] * ({taps(REC_LO)})[{tap}] "
        f"+ {high}[m // 2 + r + 1] * ({taps(REC_HI)})[{tap}]"
    )
    return (
        f"SELECT *, list_transform(range(0, 2 * len({high}) - 16), lambda m: "
        f"list_sum(list_transform(range(0, 9), lambda r: {term}))) AS {out} FROM {source}"
    )


def decomposition(source: str) -> list[tuple[str, str]]:
    return [
        ("x0", source),
        ("x1", analysis("x0", "x", "a1", "d1")),
        ("x2", analysis("x1", "a1", "a2", "d2")),
        ("x3", analysis("x2", "a2", "a3", "d3")),
        ("x4", analysis("x3", "a3", "a4", "d4")),
        (
            "noise",
            "SELECT *, list_median(list_transform(d1, lambda v: abs(v))) / 0.6745 AS sigma FROM x4",
        ),
        ("limits", "SELECT *, sigma * sqrt(2 * ln(len(x))) AS threshold FROM noise"),
    ]


def denoising(source: str) -> list[tuple[str, str]]:
    """CTEs ending in ``clean``: the input with list column ``y``, the denoised signal."""
    shrunk = ", ".join(
        f"list_transform({d}, lambda v: sign(v) * greatest(abs(v) - threshold, 0)) AS t{d}"
        for d in ("d1", "d2", "d3", "d4")
    )
    return [
        *decomposition(source),
        ("shrunk", f"SELECT *, {shrunk} FROM limits"),
        ("y3", synthesis("shrunk", "a4", "td4", "r3")),
        ("y2", synthesis("y3", "r3", "td3", "r2")),
        ("y1", synthesis("y2", "r2", "td2", "r1")),
        ("y0", synthesis("y1", "r1", "td1", "r0")),
        ("clean", "SELECT *, r0[1:len(x)] AS y FROM y0"),
    ]


def elements(
    source: str,
    keys: str,
    values: str,
    position: str = "i",
    value: str = "v",
    kind: str = "INTEGER",
) -> str:
    """One row per list element, position from 0."""
    return (
        f"SELECT {keys}, CAST(p AS {kind}) AS {position}, {rounded(value)} AS value FROM ("
        f"SELECT *, unnest({values}) AS v, unnest(range(0, len({values}))) AS p FROM {source})"
    )


EVENT_LISTS = "SELECT user_id, list(value ORDER BY i) AS x FROM indexed GROUP BY user_id"

# All events of a type as one long lead.
TYPE_INDEXED = """SELECT event_id, event_type, value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events"""
TYPE_LISTS = "SELECT event_type, list(value ORDER BY i) AS x FROM indexed GROUP BY event_type"


def windows(source: str, values: str) -> str:
    """One row per full window of 24 samples of a list column."""
    return (
        f"SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS seg_idx, {values}[24 * k + 1 : 24 * k + 24]::FLOAT[] AS s "
        f"FROM (SELECT *, unnest(range(0, len({values}) // 24)) AS k FROM {source})"
    )


SEGMENTS = [
    *denoising(LEADS),
    ("labels01", LABELS),
    ("segments", windows("clean", "y")),
    (
        "labelled",
        "SELECT s.patient_id, l.label, s.seg_idx, s.lead_idx, s.lead, s.s "
        "FROM segments s JOIN labels01 l USING (patient_id)",
    ),
    (
        "shapes",
        "SELECT patient_id, label, seg_idx, count(*) AS n_leads, min(len(s)) AS lo, "
        "max(len(s)) AS hi FROM labelled GROUP BY ALL",
    ),
    ("valid", "SELECT * FROM shapes WHERE n_leads = 12 AND lo = 24 AND hi = 24"),
    (
        "kept",
        'SELECT v.patient_id AS "group", v.label, v.seg_idx, l.lead_idx, l.s '
        "FROM labelled l JOIN valid v USING (patient_id, seg_idx)",
    ),
]
RAW_SEGMENTS = [
    ("leads", LEADS),
    ("labels01", LABELS),
    ("segments", windows("leads", "x")),
    *SEGMENTS[-4:],
]

DATASET = (
    ctes(*SEGMENTS)
    + "\n"
    + elements("kept", '"group", label, seg_idx, lead_idx', "s", "pos")
)

FILES = """SELECT vec_id,
  CASE WHEN label = 8 THEN 'unknown' ELSE CAST(vec_id // 12 AS VARCHAR) END AS folder,
  CAST(vec_id // 12 AS VARCHAR)
    || CASE label WHEN 7 THEN '-seg' WHEN 6 THEN '_x_seg' ELSE '_' || label || '_seg' END
    || vec_id || CASE WHEN label = 9 THEN '.txt' ELSE '.npy' END AS name
  FROM embeddings"""

PARSED = f"""SELECT *, TRY_CAST(str_split(name, '_')[2] AS INTEGER) AS label,
  TRY_CAST(folder AS BIGINT) AS "group" FROM ({FILES}) WHERE name LIKE '%.npy'"""

FEATURE_SQL = {
    "mean": "list_avg(x)",
    "std": "list_stddev_pop(x)",
    "min": "list_min(x)",
    "max": "list_max(x)",
    "median": "list_median(x)",
    "rms": "sqrt(list_avg(list_transform(x, lambda v: v * v)))",
    "peak_to_peak": "list_max(x) - list_min(x)",
    "zero_crossings": "len(list_filter(range(1, len(x)), lambda k: x[k] * x[k + 1] < 0))",
    **{
        f"energy_{band}": f"list_sum(list_transform({band}, lambda v: v * v))"
        for band in ("a4", "d4", "d3", "d2", "d1")
    },
}
FEATURE_CTES = [
    *decomposition(LEADS),
    (
        "features",
        "SELECT patient_id, lead_idx, CAST(len(x) AS INTEGER) AS n, "
        + ", ".join(f"{rounded(sql)} AS {name}" for name, sql in FEATURE_SQL.items())
        + " FROM x4",
    ),
]

FOLDS = f"""SELECT patient_id, label, CAST((row_number()
  OVER (PARTITION BY label ORDER BY patient_id) - 1) % 5 AS INTEGER) AS fold FROM ({LABELS})"""

PROFILE = f"""SELECT patient_id, CAST(max(len(x)) AS INTEGER) AS n_samples, count(*) AS n_leads,
  max(fs) AS fs, CAST(max(len(x) // CAST(trunc(fs * 3) AS INTEGER)) AS INTEGER) AS n_segments,
  CAST(sum(len(list_filter(x, lambda v: v IS NULL OR isnan(v)))) AS BIGINT) AS n_missing,
  string_agg(lead, ',' ORDER BY lead_idx) AS leads
  FROM ({LEADS}) GROUP BY patient_id"""

# The vectors as four-lead records of whole thousandths, sample by sample.
FILE_LEADS = f"""SELECT vec_id, label, CAST(p % 4 AS INTEGER) AS lead_idx,
  list(round(v * 1000) / 1000 ORDER BY p) AS x
  FROM (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, len(x))) AS p
    FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings))
  GROUP BY vec_id, label, p % 4"""

# 768 vectors one after another as the interleaved samples of a recording of twelve leads.
LONG_VALUES = """SELECT vec_id // 768 AS patient_id, (vec_id % 768) * 64 + p AS place, v
  FROM (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS p
    FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings))"""
LONG_SAMPLES = f"""SELECT patient_id, CAST(place % 12 AS INTEGER) AS lead_idx, place // 12 AS i,
  round(v * 1000) / 1000 AS value FROM ({LONG_VALUES})
  JOIN (SELECT patient_id, count(*) // 12 AS n FROM ({LONG_VALUES}) GROUP BY patient_id) USING (patient_id)
  WHERE place // 12 < n"""
LONG_LEADS = f"""SELECT patient_id, lead_idx, list(value ORDER BY i) AS x
  FROM ({LONG_SAMPLES}) GROUP BY patient_id, lead_idx"""

FILE_WINDOWS = """SELECT vec_id AS "group", CASE WHEN label > 0 THEN 1 ELSE 0 END AS label,
  CAST(k AS INTEGER) AS seg_idx, lead_idx, y[8 * k + 1 : 8 * k + 8]::FLOAT[] AS s
  FROM (SELECT *, unnest(range(0, len(y) // 8)) AS k FROM clean)"""

# Features of a lead, five of them band energies.
N_FEATURES = 13

# Truth and prediction as cases, with odd values and gaps.
ODD = """SELECT vec_id AS id, CASE WHEN label < 8 THEN label - 1 > 0 END AS a,
  CASE WHEN label NOT IN (5, 6) THEN vec_id % 3 > 0 END AS c FROM embeddings"""


def score(k: int) -> str:
    """A number between 0 and 1 made of all values of a vector."""
    return (
        "list_avg(list_transform(range(0, len(x)), "
        f"lambda i: abs(x[i + 1]) * ((i + {k}) % 4 + 1) / 4))"
    )


def shuffled(rows: str) -> str:
    """CTEs ending in ``walked``: the rows (id) by number, and the number each gives its value to.

    Four rounds over two halves of equal width; what is not below the number of
    rows goes through them again.
    """
    keys = [(42 * 40503 + (k + 1) * 2654435761) % 2**31 for k in range(4)]
    step = "SELECT *, x >> half AS l0, x & mask AS r0 FROM walk WHERE turn = 0 OR x >= n"
    for k, key in enumerate(keys):
        step = (
            f"SELECT *, r{k} AS l{k + 1}, xor(l{k}, ((r{k} * 1103515245 + {key}) >> 12) & mask) AS r{k + 1} "
            f"FROM ({step})"
        )
    return f"""WITH RECURSIVE numbered AS (
  SELECT id, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS n FROM ({rows})),
sized AS (
  SELECT *, CAST(ceil(len(bin(greatest(n - 1, 1))) / 2) AS BIGINT) AS half FROM numbered),
walk(id, x, n, half, mask, turn) AS (
  SELECT id, p, n, half, (1::BIGINT << half) - 1, 0 FROM sized
  UNION ALL
  SELECT id, (l4 << half) | r4, n, half, mask, turn + 1 FROM ({step})),
walked AS (
  SELECT id, x FROM walk WHERE turn > 0 AND x < n)"""


# Every row with the row that gives it its value.
DONORS = f"""{shuffled("SELECT vec_id AS id FROM embeddings")},
donors AS (
  SELECT numbered.id, walked.id AS donor FROM numbered JOIN walked ON walked.x = numbered.p)"""

# The bands of a lead one after another, named by their position.
BAND_LISTS = " UNION ALL ".join(
    f"SELECT vec_id, {b} AS band, {name} AS w FROM x4"
    for b, name in enumerate(("a4", "d4", "d3", "d2", "d1"))
)

ORACLES: dict[str, str] = {
    "sample_index": f"SELECT event_id, user_id, i FROM ({INDEXED})",
    "sample_index_hot": f"SELECT event_type, event_id, i FROM ({TYPE_INDEXED})",
    "array_to_long": elements(f"({VECTORS})", "vec_id", "x", kind="BIGINT"),
    "long_to_array": f"""SELECT user_id, i // 64 AS chunk_idx, 64 * (i // 64) AS start,
  CAST(i % 64 AS INTEGER) AS pos, {rounded("value")} AS value FROM ({INDEXED})""",
    "segment_events": f"""WITH s AS (
  SELECT user_id, CAST(i // 30 AS INTEGER) AS seg_idx, CAST(i % 30 AS INTEGER) AS pos,
    value::FLOAT AS value, count(*) OVER (PARTITION BY user_id, i // 30) AS n FROM ({INDEXED}))
SELECT user_id, seg_idx, pos, {rounded("value")} AS value FROM s WHERE n = 30""",
    "segment_arrays": ctes(("leads", LEADS), ("segments", windows("leads", "x")))
    + "\n"
    + elements("segments", "patient_id, lead_idx, seg_idx", "s", "pos"),
    "rate_rejects": f"""SELECT patient_id, lead_idx, 'no window fits the sampling rate' AS reason
FROM ({LEADS}) WHERE lead_idx IN (7, 8, 9, 10) OR trunc(lead_idx * 0.1::DOUBLE * 3) < 1""",
    "float_cast": elements(f"({VECTORS})", "vec_id", "x", value="(v / 3)::FLOAT"),
    "binarize_label": """SELECT vec_id, CASE WHEN label > 0 THEN 1 ELSE 0 END AS label
FROM embeddings""",
    "cohort_summary": """SELECT count(*) AS n_total,
  count(*) FILTER (WHERE label = 1 OR label = 2) AS n_cases,
  count(*) FILTER (WHERE label = 0) AS n_normal FROM embeddings""",
    "head_profile": f"""SELECT h.patient_id, h.brugada, p.n_samples, p.n_leads, p.fs,
  p.n_segments, p.n_missing, p.leads
FROM (SELECT * FROM ({META}) ORDER BY patient_id LIMIT 5) h
LEFT JOIN ({PROFILE}) p USING (patient_id)""",
    "record_profile": PROFILE,
    "meta_join": """SELECT d.doc_id, l.quality, l.toxic, d.lang, d.source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "missing_records": """SELECT doc_id, lang FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "completeness": """SELECT count(DISTINCT user_id) AS n, 363 AS expected,
  CASE WHEN count(DISTINCT user_id) < 300 THEN 'warn' ELSE 'ok' END AS status FROM events""",
    "parse_segment_name": f"""SELECT vec_id, folder, name, label, "group" FROM ({PARSED})
WHERE label IS NOT NULL AND "group" IS NOT NULL""",
    "reject_bad_names": f"""SELECT vec_id, folder, name, label, "group",
  CASE WHEN label IS NULL THEN 'label is not a number' ELSE 'patient is not a number' END AS reason
FROM ({PARSED}) WHERE label IS NULL OR "group" IS NULL""",
    "junk_files": """SELECT vec_id, 'raw/' || vec_id || '.hea' AS path FROM embeddings
WHERE label NOT IN (1, 2, 3)""",
    "label_fix": """SELECT e.vec_id AS patient_id,
  coalesce(l.quality, CASE WHEN e.label > 0 THEN 1 ELSE 0 END) AS brugada,
  coalesce(l.quality <> CASE WHEN e.label > 0 THEN 1 ELSE 0 END, FALSE) AS changed
FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id""",
    "wavedec": ctes(*decomposition(VECTORS), ("bands", BAND_LISTS))
    + "\n"
    + elements("bands", "vec_id, band", "w", "k"),
    "noise_sigma": ctes(*decomposition(VECTORS))
    + f"\nSELECT vec_id, {rounded('sigma')} AS sigma FROM noise",
    "universal_threshold": ctes(*decomposition(VECTORS))
    + f"\nSELECT vec_id, {rounded('threshold')} AS threshold FROM limits",
    "soft_threshold": elements(
        f"({VECTORS})", "vec_id", "x", value="sign(v) * greatest(abs(v) - 0.1::DOUBLE, 0)"
    ),
    # Nothing is shrunk, so the inverse has to give the signal back.
    "waverec": elements(f"({VECTORS})", "vec_id", "x"),
    "denoise": ctes(*denoising(VECTORS)) + "\n" + elements("clean", "vec_id", "y"),
    "clean_records": ctes(*denoising(LEADS))
    + "\n"
    + elements("clean", "patient_id, lead_idx", "y"),
    "denoise_in_steps": ctes(*denoising(VECTORS)) + "\n" + elements("clean", "vec_id", "y"),
    "denoise_events": ctes(("indexed", TYPE_INDEXED), *denoising(TYPE_LISTS))
    + "\n"
    + elements("clean", "event_type", "y", kind="BIGINT"),
    "preprocess": ctes(*denoising(LEADS), ("segments", windows("clean", "y")))
    + "\n"
    + elements("segments", "patient_id, lead_idx, seg_idx", "s", "pos"),
    "shape_valid": ctes(*RAW_SEGMENTS)
    + """
SELECT patient_id AS "group", label, seg_idx, CAST(hi AS INTEGER) AS n_samples,
  CAST(n_leads AS INTEGER) AS n_leads FROM valid""",
    "shape_rejects": ctes(*RAW_SEGMENTS)
    + """
SELECT patient_id, label, seg_idx, 'shape (' || hi || ', ' || n_leads || ')' AS reason
FROM shapes ANTI JOIN valid USING (patient_id, seg_idx)""",
    "dataset_rows": DATASET,
    "dataset_sample_major": DATASET,
    "dataset_report": ctes(*RAW_SEGMENTS)
    + """
SELECT count(*) AS n_rows, count(label) AS n_labels, count(patient_id) AS n_group_rows,
  count(DISTINCT patient_id) AS n_groups,
  count(DISTINCT (patient_id, label, seg_idx)) AS n_segments, count(*) FILTER (WHERE label = 1) AS n_positive,
  count(*) FILTER (WHERE label = 0) AS n_negative, CAST(min(lo) AS INTEGER) AS min_samples,
  CAST(max(hi) AS INTEGER) AS max_samples, CAST(min(n_leads) AS INTEGER) AS min_leads,
  CAST(max(n_leads) AS INTEGER) AS max_leads, count(*) > 0 AS ok FROM valid""",
    "metadata_scan": f"""SELECT patient_id, brugada::DOUBLE AS brugada, 'a, b' AS site
FROM ({META})""",
    "decode_recordings": f"""SELECT vec_id AS patient_id, 8.0::DOUBLE AS fs,
  CAST(p % 4 AS INTEGER) AS lead_idx, ['I', 'II', 'V1', 'V2'][p % 4 + 1] AS lead,
  CAST(p // 4 AS INTEGER) AS i, {rounded("round(v * 1000) / 1000")} AS value
FROM (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS p FROM ({VECTORS}))""",
    "decode_chunks": f"""SELECT vec_id AS patient_id, 8.0::DOUBLE AS fs,
  CAST(p % 4 AS INTEGER) AS lead_idx, ['I', 'II', 'V1', 'V2'][p % 4 + 1] AS lead,
  CAST(p // 4 AS BIGINT) AS i, {rounded("round(v * 1000) / 1000")} AS value
FROM (SELECT vec_id, unnest(x) AS v, unnest(range(0, len(x))) AS p FROM ({VECTORS}))""",
    "header_fields": """SELECT vec_id AS patient_id,
  CASE WHEN vec_id % 11 <> 3 THEN 8.0::DOUBLE END AS fs,
  CASE WHEN vec_id % 11 <> 4 THEN len(embedding) // 4 END AS n_samples,
  CASE vec_id % 11 WHEN 1 THEN 'gain not understood' WHEN 2 THEN 'baseline not understood'
    WHEN 3 THEN 'sampling rate not understood' WHEN 4 THEN 'number of samples not understood'
    WHEN 5 THEN 'offset not understood' WHEN 6 THEN 'zero not understood'
    WHEN 7 THEN 'gain not understood' END AS reason
FROM embeddings""",
    "decode_stretches": f"""SELECT patient_id, lead_idx, 'lead_' || lead_idx AS lead, CAST(i AS BIGINT) AS i,
  {rounded("value")} AS value FROM ({LONG_SAMPLES})""",
    "denoise_stretches": ctes(*denoising(LONG_LEADS))
    + "\n"
    + elements("clean", "patient_id, lead_idx", "y", kind="BIGINT"),
    "equal_copies": """SELECT patient_id, place,
  CASE WHEN patient_id % 3 = 0 THEN 'patient has several recordings'
    WHEN place = 'b' THEN 'copy of another recording' END AS reason
FROM (SELECT DISTINCT vec_id // 24 AS patient_id FROM embeddings), (VALUES ('a'), ('b'), ('c')) p(place)
WHERE place = 'a' OR (place = 'b' AND patient_id % 2 = 0) OR (place = 'c' AND patient_id % 3 = 0)""",
    "dataset_from_files": ctes(*denoising(FILE_LEADS), ("windows", FILE_WINDOWS))
    + "\n"
    + elements("windows", '"group", label, seg_idx, lead_idx', "s", "pos"),
    "dataset_with_copies": ctes(
        *denoising(FILE_LEADS), ("windows", FILE_WINDOWS + " WHERE vec_id % 7 <> 0")
    )
    + "\n"
    + elements("windows", '"group", label, seg_idx, lead_idx', "s", "pos"),
    "out_of_fold_coverage": f"""SELECT model, l.patient_id * 12 + l.lead_idx AS id, f.fold, f.label,
  true AS in_range FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id),
  (VALUES ('logistic'), ('forest')) m(model)""",
    "stacking_coverage": f"""SELECT 'logistic' AS model, l.patient_id * 12 + l.lead_idx AS id,
  f.fold, f.label, true AS in_range FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id)""",
    "ablation_sizes": f"""SELECT mode, feature_group, CAST(n_features AS INTEGER) AS n_features,
  'logistic' AS model, n FROM (SELECT count(*) AS n FROM embeddings),
  (VALUES ('all', 'all', {N_FEATURES}), ('without', 'shape', 5), ('only', 'shape', {N_FEATURES - 5}),
    ('without', 'energy', {N_FEATURES - 5}), ('only', 'energy', 5)) r(mode, feature_group, n_features)""",
    "importance_of_a_constant": """SELECT 'constant' AS feature, count(*) AS n,
  0.0::DOUBLE AS accuracy_drop, 0.0::DOUBLE AS log_loss_rise FROM embeddings""",
    "segment_table": ctes(*RAW_SEGMENTS)
    + "\n"
    + elements("labelled", "patient_id, label, lead_idx, lead, seg_idx", "s", "pos"),
    "dataset_table": DATASET,
    "lead_features": ctes(*FEATURE_CTES) + "\nSELECT * FROM features",
    "record_features": ctes(*FEATURE_CTES)
    + "\nSELECT patient_id, "
    + ", ".join(
        f"max(CASE WHEN lead_idx = {j} THEN {name} END) AS l{j}_{name}"
        for j in range(12)
        for name in FEATURE_SQL
    )
    + " FROM features GROUP BY patient_id",
    "group_kfold": f"""SELECT l.patient_id, f.label, l.lead_idx, f.fold
FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id)""",
    "group_kfold_hot": FOLDS,
    "late_fusion": f"""SELECT vec_id AS id,
  {rounded(f"0.65 * {score(0)} + 0.35 * {score(1)}")} AS p FROM ({VECTORS})""",
    "error_analysis": f"""SELECT tp, fn, fp, tn, n_unknown, {rounded("tp / nullif(tp + fn, 0)")} AS sensitivity,
  {rounded("tn / nullif(tn + fp, 0)")} AS specificity,
  {rounded("(tp + tn) / nullif(tp + fn + fp + tn, 0)")} AS accuracy
FROM (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp,
  count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn,
  count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
  count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn,
  count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS n_unknown FROM labels)""",
    "error_analysis_odd": f"""SELECT count(*) FILTER (WHERE a AND c) AS tp,
  count(*) FILTER (WHERE a AND NOT c) AS fn, count(*) FILTER (WHERE NOT a AND c) AS fp,
  count(*) FILTER (WHERE NOT a AND NOT c) AS tn,
  count(*) FILTER (WHERE a IS NULL OR c IS NULL) AS n_unknown FROM ({ODD})""",
    "error_list_odd": f"""SELECT id, CASE WHEN a IS NULL OR c IS NULL THEN 'unknown'
  WHEN a THEN 'missed' ELSE 'false alarm' END AS error
FROM ({ODD}) WHERE a IS DISTINCT FROM c OR a IS NULL""",
    "error_list": """SELECT doc_id, quality, toxic,
  CASE WHEN quality = 1 THEN 'missed' ELSE 'false alarm' END AS error
FROM labels WHERE quality <> toxic""",
    "score_columns": "SELECT vec_id AS id, "
    + ", ".join(f"{rounded(score(k))} AS s{k}" for k in range(4))
    + f" FROM ({VECTORS})",
    "score_quality": f"""SELECT source, count(*) AS n,
  {rounded("avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END)")} AS accuracy,
  {rounded("avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END))")} AS log_loss
FROM (SELECT label AS source, vec_id % 2 AS label,
  least({score(0)} * 8, 0.99::DOUBLE) AS p
  FROM (SELECT *, embedding::DOUBLE[] AS x FROM embeddings)) GROUP BY source""",
    "permute_column": f"""{DONORS}
SELECT id, label FROM donors JOIN embeddings ON vec_id = donor""",
    "fit_at_optimum": f"""SELECT t.fold, count(*) AS n_train, {rounded("avg(f.label)")} AS rate,
  true AS mean_agrees, true AS gradient_is_zero
FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id) JOIN (SELECT DISTINCT fold FROM ({FOLDS})) t ON t.fold <> f.fold
GROUP BY t.fold""",
    "stacking_at_optimum": f"""SELECT t.fold, count(*) AS n_train, {rounded("avg(f.label)")} AS rate,
  true AS mean_agrees, true AS gradient_is_zero
FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id) JOIN (SELECT DISTINCT fold FROM ({FOLDS})) t ON t.fold <> f.fold
GROUP BY t.fold""",
    "ablation_of_known": f"""WITH rows AS (
  SELECT f.label, f.fold FROM ({LEADS}) l JOIN ({FOLDS}) f USING (patient_id)),
learned AS (
  SELECT t.fold, avg(r.label) AS p FROM (SELECT DISTINCT fold FROM rows) t JOIN rows r ON r.fold <> t.fold GROUP BY t.fold),
blind AS (
  SELECT count(*) AS n, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS accuracy,
    avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) AS log_loss FROM rows JOIN learned USING (fold))
SELECT mode, feature_group, 'logistic' AS model, n, round(accuracy, 4) + 0.0 AS accuracy, round(log_loss, 4) + 0.0 AS log_loss
FROM blind, (VALUES ('only', 'nothing'), ('without', 'answer')) r(mode, feature_group)
UNION ALL
SELECT mode, feature_group, 'forest', n, 1.0::DOUBLE, 0.0::DOUBLE
FROM blind, (VALUES ('only', 'answer'), ('without', 'nothing')) r(mode, feature_group)""",
    "importance_of_the_answer": f"""{DONORS}
SELECT 'answer' AS feature, count(*) AS n,
  round(avg(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END), 4) + 0.0 AS accuracy_drop,
  round(avg(CASE WHEN a.label <> b.label THEN -ln(1e-15::DOUBLE) ELSE 0 END), 4) + 0.0 AS log_loss_rise
FROM donors JOIN ({LABELS}) a ON a.patient_id = id // 12 JOIN ({LABELS}) b ON b.patient_id = donor // 12""",
    "published_patients": """SELECT vec_id % 97 AS "group", vec_id,
  CASE WHEN vec_id % 97 % 3 <> 0 THEN label WHEN vec_id % 97 < 30 THEN label + 200 ELSE label + 100 END AS label
FROM embeddings WHERE NOT (vec_id % 97 < 30 AND vec_id % 97 % 6 = 0)""",
}

ORACLES["report_on_write"] = ORACLES["dataset_report"]
