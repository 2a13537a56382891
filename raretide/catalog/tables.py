"""Sources, sinks, projections, filters, joins, splits, sets and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from raretide.catalog.base import clean_rows, labelled_rows, query, r, raw_inputs, staged_rows
from raretide.functions import scalars as S
from raretide.functions.calendar import is_us_federal_holiday
from raretide.operators import clean, joins, key_sets, profile, split, windows as W
from raretide.plans import ingest
from raretide.session import new_path
from raretide.sources import buckets, files
from raretide.sources.tables import raw_table

# -- sources and sinks -------------------------------------------------------------------------------------

@query("src1_read_transactions_csv", "SRC1", sql="SELECT * FROM transactions_raw")
def _(spark, d):
    path = new_path(spark, "transactions-csv")
    raw = raw_table(spark, d, "transactions_raw")
    raw.withColumn("date", F.col("date").cast("string")).write.csv(path, header=True)
    return files.read_csv(spark, path, files.TRANSACTIONS_SCHEMA)


@query("src1_read_users_csv", "SRC1", "PRJ1", sql="SELECT * FROM users")
def _(spark, d):
    path = new_path(spark, "users-csv")
    clean.rename(raw_table(spark, d, "users"), {"client_id": "id"}).write.csv(path, header=True)
    return files.read_csv(spark, path, files.USERS_SCHEMA, {"id": "client_id"})


@query("src1_read_cards_csv", "SRC1", "PRJ1", sql="SELECT * FROM cards")
def _(spark, d):
    path = new_path(spark, "cards-csv")
    clean.rename(raw_table(spark, d, "cards"), {"card_id": "id"}).write.csv(path, header=True)
    return files.read_csv(spark, path, files.CARDS_SCHEMA, {"id": "card_id"})


@query("src1_read_shuffled_users_csv", "SRC1", "PRJ1", sql="SELECT *, CAST(current_age AS VARCHAR) AS extra FROM users")
def _(spark, d):
    """A file whose columns stand in another order and which has one more."""
    path = new_path(spark, "users-shuffled-csv")
    users = clean.rename(raw_table(spark, d, "users").withColumn("extra", F.col("current_age").cast("string")), {"client_id": "id"})
    users.select(*sorted(users.columns, reverse=True)).write.csv(path, header=True)
    return files.read_csv(spark, path, files.USERS_SCHEMA, {"id": "client_id"})


@query("src2_read_mcc_json", "SRC2", "SCL2", sql="SELECT mcc, description FROM mcc_codes")
def _(spark, d):
    path = new_path(spark, "mcc-json")
    # at most one entry per four-digit code, so one JSON object is small
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("mcc").cast("string"), "description")))
    raw_table(spark, d, "mcc_codes").agg(F.to_json(pairs).alias("value")).write.text(path)
    return files.read_json_map(spark, path)


@query("src3_read_label_object", "SRC3", sql="SELECT id, target FROM fraud_labels")
def _(spark, d):
    """Entries of ``"10": "No",`` form, written and read in parallel as the pieces of one JSON object."""
    path = new_path(spark, "labels-json")
    entry = F.format_string('"%d": "%s"', "id", "target").alias("value")
    raw_table(spark, d, "fraud_labels").select(entry).write.option("lineSep", ",").text(path)
    return files.read_label_object(spark, path)


@query("src3_read_label_lines", "SRC3", sql="SELECT id, target FROM fraud_labels")
def _(spark, d):
    path = new_path(spark, "labels-jsonl")
    raw_table(spark, d, "fraud_labels").write.json(path)
    return files.read_label_lines(spark, path)


@query("src4_read_parquet", "SRC4", sql=f"SELECT event_id, ts, user_id, event_type, {r('value')}, props FROM events")
def _(spark, d):
    return files.read_parquet(spark, f"{d}/events.parquet")


@query("snk1_split_tables", "SNK1", sql="SELECT split, count(*) AS n, count(target) AS labelled, min(date) AS first, "
       "max(date) AS last FROM wide GROUP BY split")
def _(spark, d):
    path = new_path(spark, "splits")
    ingest.write_splits(raw_inputs(spark, d), path)
    return files.read_parquet(spark, path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count("target").alias("labelled"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


@query("snk2_feature_table", "SNK2", sql=f"""SELECT date_window, count(amount) AS transactions,
  CAST(sum(target) AS BIGINT) AS frauds, {r('sum(amount)', 'total_amount')} FROM w360 GROUP BY date_window""")
def _(spark, d):
    path = new_path(spark, "features")
    files.write_parquet(W.window_totals(clean_rows(spark, d)), path)
    return files.read_parquet(spark, path)


# -- reports -----------------------------------------------------------------------------------------------

@query("ins1_head", "INS1", "SRT1", sql=f"SELECT id, date, client_id, {r('amount')} FROM typed ORDER BY date, id LIMIT 20")
def _(spark, d):
    rows = clean.type_transactions(raw_table(spark, d, "transactions_raw"))
    return profile.peek(rows.select("id", "date", "client_id", "amount"), 20, ["date", "id"])


_PROFILED = ("id", "amount", "zip", "merchant_state", "errors", "description", "target")


@query("ins2_null_profile", "INS2", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null FROM enriched" for i, c in enumerate(_PROFILED)))
def _(spark, d):
    return profile.column_profile(ingest.enrich(raw_inputs(spark, d)).select(*_PROFILED)).drop("type")


@query("ins3_shape", "INS3", sql="SELECT count(*) AS \"rows\", 24 AS columns FROM labelled")
def _(spark, d):
    return profile.shape(labelled_rows(spark, d))


_DESCRIBED = ("amount", "credit_score", "current_age", "total_debt", "zip")


@query("ins4_describe", "INS4", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, "
    f"{r(f'CAST(min({c}) AS DOUBLE)', 'min')}, {r(f'quantile_cont({c}, 0.25)', 'q25')}, {r(f'quantile_cont({c}, 0.5)', 'q50')}, "
    f"{r(f'quantile_cont({c}, 0.75)', 'q75')}, {r(f'CAST(max({c}) AS DOUBLE)', 'max')} FROM clean" for c in _DESCRIBED))
def _(spark, d):
    return profile.describe(staged_rows(spark, d, *_DESCRIBED), _DESCRIBED)


# -- projections and filters -------------------------------------------------------------------------------

@query("prj1_rename_keys", "PRJ1", sql="SELECT card_id AS card, client_id AS owner, has_chip FROM cards")
def _(spark, d):
    return clean.rename(raw_table(spark, d, "cards"), {"card_id": "card", "client_id": "owner"}).drop("credit_limit")


@query("prj2_select_drop", "PRJ2", sql="SELECT id, client_id, merchant_id FROM transactions_raw")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").select("id", "client_id", "merchant_id", "zip").drop("zip")


@query("prj3_clean_names", "PRJ3", sql="SELECT id AS tx_id, client_id AS clientgroup, merchant_id AS merchantid FROM transactions_raw")
def _(spark, d):
    rows = raw_table(spark, d, "transactions_raw")
    named = rows.select(F.col("id").alias("tx-id"), F.col("client_id").alias("client&_group"),
                        F.col("merchant_id").alias("merchant__(id)"))
    return clean.clean_names(named)


@query("prj4_categories", "PRJ4", "SCL4", "SCL5", "SCL6",
       sql="SELECT id, online_sales, city, country, card_has_chip FROM clean")
def _(spark, d):
    return clean_rows(spark, d).select("id", "online_sales", "city", "country", "card_has_chip")


@query("prj5_binary_target", "PRJ5", sql="SELECT id, CASE WHEN target = 'Yes' THEN 1 ELSE 0 END AS target FROM fraud_labels")
def _(spark, d):
    return clean.binary_target(raw_table(spark, d, "fraud_labels"))


@query("prj6_recode_flags", "PRJ6", sql="""SELECT use_chip AS use_chip, online_sales, card_has_chip, count(*) AS n FROM (
  SELECT CASE use_chip WHEN 'Chip Transaction' THEN 1 WHEN 'Swipe Transaction' THEN 0 WHEN 'Online' THEN 0 END AS use_chip,
    CASE online_sales WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS online_sales,
    CASE card_has_chip WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS card_has_chip FROM clean) q GROUP BY 1, 2, 3""")
def _(spark, d):
    rows = clean.recode_for_series(clean_rows(spark, d))
    return rows.groupBy("use_chip", "online_sales", "card_has_chip").agg(F.count(F.lit(1)).alias("n"))


@query("prj7_rescale", "PRJ7", "FE11", sql=f"""SELECT id, {r('amount / 1000', 'amount')},
  {r('per_capita_income / 1000', 'per_capita_income')}, {r('total_debt / 10000', 'total_debt')},
  {r('credit_score / 100.0', 'credit_score')}, {r('credit_limit / 10000', 'credit_limit')} FROM clean""")
def _(spark, d):
    return clean.rescale(clean_rows(spark, d), W.SCALE_FACTORS).select("id", *W.SCALE_FACTORS)


@query("prj8_fill_nulls", "PRJ8", sql="SELECT id, coalesce(zip, 0.0) + 0.0 AS zip, coalesce(errors, 'No Error') AS errors FROM clean")
def _(spark, d):
    return clean.recode_for_series(clean_rows(spark, d)).select("id", "zip", "errors")


@query("flt1_non_negative", "FLT1", sql=f"SELECT id, {r('amount')} FROM typed WHERE amount >= 0")
def _(spark, d):
    return clean.keep_non_negative(clean.type_transactions(raw_table(spark, d, "transactions_raw"))).select("id", "amount")


@query("flt2_labelled_or_not", "FLT2", sql="SELECT target IS NULL AS unlabelled, count(*) AS n FROM enriched GROUP BY 1")
def _(spark, d):
    rows = ingest.enrich(raw_inputs(spark, d)).select(F.col("target").isNull().alias("unlabelled"))
    parts = [rows.where(flag) for flag in ("unlabelled", "not unlabelled")]
    return parts[0].union(parts[1]).groupBy("unlabelled").agg(F.count(F.lit(1)).alias("n"))


@query("flt3_temporal_cut", "FLT3", sql="SELECT id, date FROM transactions_raw WHERE epoch_us(date) > (SELECT us FROM cut)")
def _(spark, d):
    raw = raw_inputs(spark, d)
    cut = F.lit(ingest.fraud_cut(raw)).cast("timestamp_ntz")
    return raw.transactions.where(F.col("date") > cut).select("id", "date")


@query("flt4_conditional_counts", "FLT4", sql="""SELECT date_window,
  count(*) FILTER (WHERE use_chip = 'Chip Transaction') AS chips, count(*) FILTER (WHERE errors IS NOT NULL) AS bad,
  count(*) FILTER (WHERE target = 1) AS frauds FROM w360 GROUP BY date_window""")
def _(spark, d):
    rows = W.add_window(clean.recode_for_series(clean_rows(spark, d)), "360m")
    return rows.groupBy("date_window").agg(
        F.count_if(F.col("use_chip") == 1).alias("chips"),
        F.count_if(F.col("errors") != S.NO_ERROR).alias("bad"),
        F.count_if(F.col("target") == 1).alias("frauds"),
    )


@query("flt5_complete_rows", "FLT5", sql=f"SELECT id, zip + 0.0 AS zip, description FROM clean WHERE zip IS NOT NULL AND description IS NOT NULL")
def _(spark, d):
    return clean_rows(spark, d).select("id", "zip", "description").dropna("any")


@query("smp1_seeded_sample", "SMP1")
def _(spark, d):
    return profile.seeded_sample(W.window_totals(clean_rows(spark, d)).select("date_window", "frauds"), 5, "date_window")


@query("lkp1_sample_labels", "LKP1", sql="""SELECT date_window, CAST(sum(target) AS BIGINT) AS frauds FROM w360
  GROUP BY date_window ORDER BY date_window LIMIT 5""")
def _(spark, d):
    table = W.window_totals(clean_rows(spark, d))
    sample = table.select("date_window").orderBy("date_window").limit(5)
    return profile.labels_of(sample, table, "date_window", "frauds")


# -- split -------------------------------------------------------------------------------------------------

@query("spl1_cut_date", "SPL1", sql="SELECT make_timestamp(us) AS cut FROM cut")
def _(spark, d):
    cut = ingest.fraud_cut(raw_inputs(spark, d))
    return spark.range(1).select(F.lit(cut).cast("timestamp_ntz").alias("cut"))


@query("spl2_three_way", "SPL2", sql="SELECT id, split FROM wide")
def _(spark, d):
    raw = raw_inputs(spark, d)
    return split.with_split(ingest.enrich(raw), ingest.fraud_cut(raw)).select("id", "split")


_WIDE = ("id", "date", "client_id", "card_id", "amount", "mcc", "description", "target", "current_age",
         "per_capita_income", "total_debt", "credit_score", "has_chip", "credit_limit", "split")
_WIDE_SQL = ", ".join(r(c) if c in ("amount", "per_capita_income", "total_debt", "credit_limit") else c for c in _WIDE)


@query("spl3_split_tables", "SPL3", "PRJ1", "SCL3", "PIPE1", sql=f"SELECT {_WIDE_SQL} FROM wide")
def _(spark, d):
    return ingest.split_table(raw_inputs(spark, d)).select(*_WIDE)


@query("plan1_files_to_validation_split", "PIPE1", "SRC1", "SRC2", "SRC3", "SNK1",
       sql=f"SELECT {_WIDE_SQL} FROM wide WHERE split = 'validation'")
def _(spark, d):
    """The whole way: five files are written, read, joined, split, written as a split table and read back."""
    raw = raw_inputs(spark, d)
    folder, out = new_path(spark, "raw-files"), new_path(spark, "splits")
    raw.transactions.withColumn("date", F.col("date").cast("string")).write.csv(f"{folder}/transactions_data.csv", header=True)
    raw.users.write.csv(f"{folder}/users_data.csv", header=True)
    raw.cards.write.csv(f"{folder}/cards_data.csv", header=True)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("mcc").cast("string"), "description")))
    raw.mcc_codes.agg(F.to_json(pairs).alias("value")).write.text(f"{folder}/mcc_codes.json")
    entry = F.format_string('"%d": "%s"', "id", "target").alias("value")
    raw.labels.select(entry).write.option("lineSep", ",").text(f"{folder}/train_fraud_labels.json")
    ingest.write_splits(ingest.read_inputs(spark, folder), out)
    rows = files.read_parquet(spark, out)
    return split.in_split(rows, split.VALIDATION).select(*_WIDE)


# -- joins -------------------------------------------------------------------------------------------------

@query("jn1_mcc", "JN1", sql="SELECT t.id, t.mcc, m.description FROM transactions_raw t LEFT JOIN mcc_codes m ON t.mcc = m.mcc")
def _(spark, d):
    codes = joins.broadcast_if_small(raw_table(spark, d, "mcc_codes"))
    return raw_table(spark, d, "transactions_raw").join(codes, "mcc", "left").select("id", "mcc", "description")


@query("jn2_labels", "JN2", sql="SELECT t.id, l.target FROM transactions_raw t LEFT JOIN fraud_labels l ON t.id = l.id")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").join(raw_table(spark, d, "fraud_labels"), "id", "left").select("id", "target")


def together(frames, key, count=8):
    """Tables bucketed under new names, in the order given."""
    tag = uuid.uuid4().hex[:12]
    return buckets.write_together({f"{name}_{tag}": df for name, df in frames.items()}, key, count).values()


@query("jn2_labels_bucketed", "JN2", "SNK1", sql="SELECT t.id, l.target FROM transactions_raw t LEFT JOIN fraud_labels l ON t.id = l.id")
def _(spark, d):
    """Both tables stored by the hash of ``id``: the join itself shuffles nothing."""
    raw = {name: raw_table(spark, d, name) for name in ("transactions_raw", "fraud_labels")}
    transactions, labels = together(raw, "id")
    return transactions.join(labels, "id", "left").select("id", "target")


@query("jn2_frauds_filtered", "JN2", "FLT2", sql=f"""SELECT t.id, t.date, {r('t.amount', 'amount')} FROM typed t
  JOIN fraud_labels l ON t.id = l.id WHERE l.target = 'Yes'""")
def _(spark, d):
    """Fraud rows alone: transactions that are no fraud go before the shuffle of the join."""
    frauds = raw_table(spark, d, "fraud_labels").where(F.col("target") == "Yes").select("id")
    rows = clean.type_transactions(raw_table(spark, d, "transactions_raw")).select("id", "date", "amount")
    return key_sets.join_filtered(rows, frauds, "id")


@query("jn3_users_filtered", "JN3", sql=f"""SELECT client_id, current_age, {r('total_debt')} FROM typed_users
  WHERE client_id IN (SELECT client_id FROM transactions_raw WHERE merchant_id % 10 = 3)""")
def _(spark, d):
    """The semi-join through an exact set of the keys."""
    rows = raw_table(spark, d, "transactions_raw").where("merchant_id % 10 = 3")
    users = clean.type_users(raw_table(spark, d, "users"))
    return key_sets.seen_in_filtered(users, rows, "client_id").select("client_id", "current_age", "total_debt")


@query("jn3_users_of_cities_filtered", "JN3", sql="""SELECT city, count(*) AS n FROM (SELECT DISTINCT client_id, merchant_city AS city
  FROM transactions_raw) WHERE city IN (SELECT merchant_city FROM transactions_raw WHERE mcc = 5003 AND amount LIKE '$-%') GROUP BY city""")
def _(spark, d):
    """The semi-join on a text key: a hashed filter first, then the join of what passes."""
    rows = raw_table(spark, d, "transactions_raw")
    clients = rows.select("client_id", F.col("merchant_city").alias("city")).distinct()
    refunds = rows.where("mcc = 5003 AND amount LIKE '$-%'").select(F.col("merchant_city").alias("city"))
    return key_sets.seen_in_filtered(clients, refunds, "city").groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("jn3_seen_dimensions", "JN3", sql="""SELECT 'users' AS dimension, s.split, count(*) AS n FROM users u
  JOIN (SELECT DISTINCT split, client_id FROM wide) s ON u.client_id = s.client_id GROUP BY ALL
  UNION ALL SELECT 'cards', s.split, count(*) FROM cards c
  JOIN (SELECT DISTINCT split, card_id FROM wide) s ON c.card_id = s.card_id GROUP BY ALL""")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = split.with_split(ingest.enrich(raw), ingest.fraud_cut(raw)).select("split", "client_id", "card_id")
    def per_split(label, dim, key):
        seen = joins.seen_by_group(dim, rows, "split", key).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
        return seen.select(F.lit(label).alias("dimension"), "split", "n")

    return per_split("users", raw.users, "client_id").union(per_split("cards", raw.cards, "card_id"))


@query("jn3_users_of_validation", "JN3", sql=f"""SELECT client_id, current_age, {r('total_debt')} FROM typed_users
  WHERE client_id IN (SELECT client_id FROM wide WHERE split = 'validation')""")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = split.with_split(ingest.enrich(raw), ingest.fraud_cut(raw))
    users = joins.seen_in(clean.type_users(raw.users), split.in_split(rows, split.VALIDATION), "client_id")
    return users.select("client_id", "current_age", "total_debt")


@query("jn4_users_and_cards", "JN4", sql=f"""SELECT id, client_id, card_id, credit_score, {r('per_capita_income')}, has_chip,
  {r('credit_limit')} FROM wide""")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = split.join_dimensions(raw.transactions, clean.type_users(raw.users), clean.type_cards(raw.cards))
    return rows.select("id", "client_id", "card_id", "credit_score", "per_capita_income", "has_chip", "credit_limit")


@query("jn4_users_and_cards_spread", "JN4", sql=f"""SELECT id, client_id, card_id, credit_score, {r('per_capita_income')}, has_chip,
  {r('credit_limit')} FROM wide""")
def _(spark, d):
    """The same join with every client above 50 rows treated as hot."""
    raw = raw_inputs(spark, d)
    hot = joins.hot_keys(raw.transactions, "client_id", hot_rows=50)
    rows = split.join_dimensions(raw.transactions, clean.type_users(raw.users), clean.type_cards(raw.cards), hot)
    return rows.select("id", "client_id", "card_id", "credit_score", "per_capita_income", "has_chip", "credit_limit")


@query("jn4_users_and_cards_bucketed", "JN4", sql=f"""SELECT id, client_id, card_id, credit_score, {r('per_capita_income')}, has_chip,
  {r('credit_limit')} FROM wide""")
def _(spark, d):
    """The same join over tables stored by the hash of ``client_id``."""
    raw = raw_inputs(spark, d)
    frames = {"transactions": raw.transactions, "users": clean.type_users(raw.users), "cards": clean.type_cards(raw.cards)}
    rows = split.join_dimensions(*together(frames, "client_id"))
    return rows.select("id", "client_id", "card_id", "credit_score", "per_capita_income", "has_chip", "credit_limit")


# -- sorts and sets ----------------------------------------------------------------------------------------

@query("srt1_by_date", "SRT1", sql="SELECT id, date FROM transactions_raw ORDER BY date, id")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").select("id", "date").orderBy("date", "id")


@query("srt2_mixed_order", "SRT2", sql="""SELECT date_window, CAST(sum(target) AS BIGINT) AS frauds FROM w360
  GROUP BY date_window ORDER BY frauds DESC, date_window""")
def _(spark, d):
    totals = W.window_totals(clean_rows(spark, d)).select("date_window", "frauds")
    return totals.orderBy(F.col("frauds").desc(), "date_window")


@query("set1_concat_splits", "SET1", sql="SELECT id, split FROM wide WHERE split <> 'notarget'")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = split.with_split(ingest.enrich(raw), ingest.fraud_cut(raw)).select("id", "split")
    return split.in_split(rows, split.TRAIN_TEST).unionByName(split.in_split(rows, split.VALIDATION))


@query("set2_unique_windows", "SET2", sql="SELECT DISTINCT date_window FROM w360")
def _(spark, d):
    return W.add_window(clean_rows(spark, d), "360m").select("date_window").distinct()


# -- scalar functions --------------------------------------------------------------------------------------

@query("scl1_money", "SCL1", sql=f"SELECT id, {r('amount')} FROM typed")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").select("id", S.money("amount").alias("amount"))


@query("scl1_money_lenient", "SCL1", sql=f"SELECT client_id, {r('total_debt')}, CAST(NULL AS DOUBLE) AS junk FROM typed_users")
def _(spark, d):
    return raw_table(spark, d, "users").select(
        "client_id", S.money("total_debt", lenient=True).alias("total_debt"),
        S.money(F.concat(F.lit("x"), "total_debt"), lenient=True).alias("junk"),
    )


@query("scl2_mcc_casts", "SCL2", sql="SELECT id, CAST(mcc AS VARCHAR) AS mcc, mcc AS code FROM transactions_raw")
def _(spark, d):
    text = F.col("mcc").cast("string")
    return raw_table(spark, d, "transactions_raw").select("id", text.alias("mcc"), text.cast("int").alias("code"))


@query("scl3_to_timestamp", "SCL3", sql="SELECT id, date FROM transactions_raw")
def _(spark, d):
    rows = raw_table(spark, d, "transactions_raw").select("id", F.col("date").cast("string").alias("date"))
    return rows.withColumn("date", F.to_timestamp_ntz("date"))


@query("scl4_online", "SCL4", sql="""SELECT id, CASE WHEN lower(merchant_city) = 'online' THEN 'Yes' ELSE 'No' END AS online_sales,
  CASE WHEN lower(merchant_city) = 'online' THEN 'Online' ELSE merchant_city END AS city FROM transactions_raw""")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").select(
        "id", S.online_sales("merchant_city").alias("online_sales"), S.sale_city("merchant_city").alias("city")
    )


@query("scl5_country", "SCL5", sql="""SELECT id, coalesce(CASE WHEN length(merchant_state) = 2 THEN 'United States'
  ELSE merchant_state END, 'Online') AS country FROM transactions_raw""")
def _(spark, d):
    return raw_table(spark, d, "transactions_raw").select("id", S.sale_country("merchant_state").alias("country"))


@query("scl6_card_chip", "SCL6", sql="SELECT card_id, CASE WHEN lower(has_chip) = 'yes' THEN 'Yes' ELSE 'No' END AS card_has_chip FROM cards")
def _(spark, d):
    return raw_table(spark, d, "cards").select("card_id", S.chip_flag("has_chip").alias("card_has_chip"))


@query("scl7_truncate", "SCL7", sql="""SELECT id, make_timestamp(epoch_us(date) // 5400000000 * 5400000000) AS m90,
  date_trunc('day', date) AS d1, CAST(date_trunc('week', date) AS TIMESTAMP) AS w1,
  CAST(date_trunc('month', date) AS TIMESTAMP) AS mo1 FROM transactions_raw""")
def _(spark, d):
    rows = raw_table(spark, d, "transactions_raw")
    for name, spec in (("m90", "90m"), ("d1", "1d"), ("w1", "1w"), ("mo1", "1mo")):
        rows = rows.withColumn(name, S.truncate("date", spec))
    return rows.select("id", "m90", "d1", "w1", "mo1")


@query("scl8_hour_bounds", "SCL8", sql="""SELECT date_trunc('hour', min(date)) AS first, CASE WHEN date_trunc('hour', max(date)) = max(date)
  THEN max(date) ELSE date_trunc('hour', max(date)) + INTERVAL 1 HOUR END AS last FROM clean""")
def _(spark, d):
    hour = F.expr("INTERVAL 1 HOUR")
    ends = clean_rows(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    floor = {c: F.date_trunc("hour", c).cast("timestamp_ntz") for c in "ab"}
    last = F.when(floor["b"] == F.col("b"), F.col("b")).otherwise(floor["b"] + hour)
    return ends.select(floor["a"].alias("first"), last.alias("last"))


@query("scl9_calendar_parts", "SCL9", sql="""SELECT id, CAST(hour(date) AS INT) AS hour_of_day, CAST(isodow(date) - 1 AS INT) AS day_of_week,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM transactions_raw""")
def _(spark, d):
    from raretide.operators.dense import seasonal

    return raw_table(spark, d, "transactions_raw").select("id", *seasonal("date")[:3])


# The observed federal holidays of the year the events cover and of the one after it.
_HOLIDAYS = ("2024-01-01", "2024-01-15", "2024-02-19", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02",
             "2024-10-14", "2024-11-11", "2024-11-28", "2024-12-25", "2025-01-01", "2025-01-20", "2025-02-17",
             "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-10-13", "2025-11-11", "2025-11-27", "2025-12-25")


@query("scl10_holidays", "SCL10", sql=f"""SELECT id, CAST(date AS DATE) IN ({', '.join(f"DATE '{h}'" for h in _HOLIDAYS)}) AS is_holiday,
  CAST(date AS DATE) + CAST(merchant_id * 6 AS INTEGER) IN ({', '.join(f"DATE '{h}'" for h in _HOLIDAYS)}) AS later_is_holiday
  FROM transactions_raw""")
def _(spark, d):
    rows = raw_table(spark, d, "transactions_raw")
    later = F.date_add(F.to_date("date"), F.col("merchant_id") * 6)
    return rows.withColumn("later", later).select("id", is_us_federal_holiday("date").alias("is_holiday"),
                                                  is_us_federal_holiday("later").alias("later_is_holiday"))


@query("scl11_guarded_ratios", "SCL11", sql=f"""SELECT merchant_id, {r('''CASE WHEN n = 1 THEN 100.0
  WHEN 1.0 * s / (n - 1) > 100 THEN 100.0 ELSE 1.0 * s / (n - 1) END''', 'capped')},
  {r('1.0 * n / CASE WHEN s = 0 THEN 1 ELSE s END', 'as_one')}
  FROM (SELECT merchant_id, count(*) AS n, sum(target) AS s FROM clean GROUP BY 1) q""")
def _(spark, d):
    sums = clean_rows(spark, d).groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("s"))
    return sums.select("merchant_id", S.capped_ratio(F.col("s").cast("double"), F.col("n") - 1).alias("capped"),
                       S.ratio_zero_as_one(F.col("n"), F.col("s")).alias("as_one"))
