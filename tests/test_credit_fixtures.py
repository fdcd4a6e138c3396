"""Fixtures shaped like the reference's credit tables, a few hand-written rows per table,
covering the cases listed in FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from riskloom.plans import credit as C
from riskloom.sources.csv import read_csv

APP_SCHEMA = ("SK_ID_CURR bigint, TARGET double, CODE_GENDER string, FLAG_OWN_CAR string, "
              "FLAG_OWN_REALTY string, NAME_CONTRACT_TYPE string, DAYS_BIRTH bigint, DAYS_EMPLOYED bigint, "
              "AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, CNT_FAM_MEMBERS double")
APP_TRAIN = [
    (100, 0.0, "M", "N", "Y", "Cash loans", -10000, -1000, 100000.0, 200000.0, 10000.0, 2.0),
    (101, 1.0, "F", "Y", "N", "Revolving loans", -12000, 365243, 50000.0, 0.0, 5000.0, 1.0),
    (102, 0.0, "XNA", "N", "N", "Cash loans", -9000, -100, 1.0, 1.0, 1.0, 1.0),
    (103, 0.0, None, "Y", "Y", None, -15000, -5000, 0.0, 0.0, -1.0, 0.0),
]
APP_TEST = [(200, None, "F", "N", "Y", "Cash loans", -11000, -2000, 80000.0, 160000.0, 8000.0, 3.0)]


@pytest.fixture(scope="module")
def app(spark):
    schema = APP_SCHEMA
    train = spark.createDataFrame(APP_TRAIN, schema)
    test = spark.createDataFrame(APP_TEST, schema).drop("TARGET")
    return C.application_features(train, test)


def test_application(app):
    rows = {r.SK_ID_CURR: r for r in app.collect()}
    assert 102 not in rows                       # 'XNA' dropped
    assert rows[103].CODE_GENDER == -1           # missing gender kept, code -1
    assert rows[101].DAYS_EMPLOYED is None and rows[101].DAYS_EMPLOYED_PERC is None
    assert rows[101].INCOME_CREDIT_PERC == math.inf and rows[101].PAYMENT_RATE == math.inf
    assert rows[103].INCOME_CREDIT_PERC is None          # 0 / 0
    assert rows[103].PAYMENT_RATE == -math.inf           # -1 / 0
    assert rows[200].TARGET is None
    assert "NAME_CONTRACT_TYPE_Cash loans" in app.columns
    assert "NAME_CONTRACT_TYPE_nan" not in app.columns   # nan_as_category off for applications
    # codes in order of first appearance by applicant id: M(100), F(101)
    assert rows[100].CODE_GENDER == 0 and rows[101].CODE_GENDER == 1 and rows[200].CODE_GENDER == 1


BUREAU = [
    # SK_ID_CURR, SK_ID_BUREAU, CREDIT_ACTIVE, DAYS_CREDIT, DAYS_CREDIT_ENDDATE, DAYS_CREDIT_UPDATE,
    # CREDIT_DAY_OVERDUE, AMT_CREDIT_MAX_OVERDUE, AMT_CREDIT_SUM, AMT_CREDIT_SUM_DEBT,
    # AMT_CREDIT_SUM_OVERDUE, AMT_CREDIT_SUM_LIMIT, AMT_ANNUITY, CNT_CREDIT_PROLONG
    (100, 1, "Active", -100, 50.0, -10, 0, None, 1000.0, 500.0, 0.0, None, 10.0, 0),
    (100, 2, "Closed", -300, -20.0, -30, 0, 5.0, 2000.0, 0.0, 0.0, None, None, 1),
    (101, 3, "Closed", -50, None, -5, 3, None, 300.0, None, 0.0, None, None, 0),   # no Active loan
    (103, 4, None, -70, 10.0, -1, 0, None, 100.0, 10.0, 0.0, 50.0, None, 0),       # loan without history
]
BUREAU_SCHEMA = ("SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string, DAYS_CREDIT bigint, "
                 "DAYS_CREDIT_ENDDATE double, DAYS_CREDIT_UPDATE bigint, CREDIT_DAY_OVERDUE bigint, "
                 "AMT_CREDIT_MAX_OVERDUE double, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, "
                 "AMT_CREDIT_SUM_OVERDUE double, AMT_CREDIT_SUM_LIMIT double, AMT_ANNUITY double, "
                 "CNT_CREDIT_PROLONG bigint")
BB = [(1, 0, "C"), (1, -1, "0"), (1, -2, None), (2, 0, "C"), (3, -5, "X"), (99, 0, "C")]  # 99: no loan


@pytest.fixture(scope="module")
def bureau(spark):
    b = spark.createDataFrame(BUREAU, BUREAU_SCHEMA)
    bb = spark.createDataFrame(BB, "SK_ID_BUREAU bigint, MONTHS_BALANCE bigint, STATUS string")
    return C.bureau_and_balance(b, bb)


def test_bureau(bureau):
    rows = {r.SK_ID_CURR: r for r in bureau.collect()}
    assert set(rows) == {100, 101, 103}
    r = rows[100]
    assert r.BURO_DAYS_CREDIT_MIN == -300 and r.BURO_DAYS_CREDIT_VAR == 20000.0
    assert r.BURO_MONTHS_BALANCE_SIZE_SUM == 4 and r.BURO_MONTHS_BALANCE_SIZE_MEAN == 2.0
    assert r.BURO_AMT_CREDIT_SUM_LIMIT_MEAN is None and r.BURO_AMT_CREDIT_SUM_LIMIT_SUM == 0.0
    assert r.BURO_CREDIT_ACTIVE_Active_MEAN == 0.5
    # mean of per-loan shares: loan 1 = 1/3 'C', loan 2 = 1 'C'
    assert abs(r.BURO_STATUS_C_MEAN_MEAN - (1 / 3 + 1) / 2) < 1e-12
    assert r.ACTIVE_AMT_CREDIT_SUM_SUM == 1000.0 and r.CLOSED_CNT_CREDIT_PROLONG_SUM == 1
    # applicant without an Active loan: every ACTIVE_ output NULL, sums included
    r = rows[101]
    assert r.ACTIVE_AMT_CREDIT_SUM_SUM is None and r.ACTIVE_DAYS_CREDIT_MEAN is None
    assert r.ACTIVE_MONTHS_BALANCE_SIZE_SUM is None
    assert r.BURO_DAYS_CREDIT_VAR is None          # one loan
    # loan without history: balance outputs NULL and skipped; null status shares
    r = rows[103]
    assert r.BURO_MONTHS_BALANCE_MIN_MIN is None and r.BURO_MONTHS_BALANCE_SIZE_MEAN is None
    assert r.BURO_MONTHS_BALANCE_SIZE_SUM == 0
    assert r.BURO_CREDIT_ACTIVE_nan_MEAN == 1.0 and r.ACTIVE_DAYS_CREDIT_MIN is None


INS = [
    # SK_ID_CURR, NUM_INSTALMENT_VERSION, DAYS_INSTALMENT, DAYS_ENTRY_PAYMENT, AMT_INSTALMENT, AMT_PAYMENT
    (100, 1.0, -10.0, -5.0, 100.0, 50.0),
    (100, 2.0, -20.0, -25.0, 0.0, 10.0),
    (100, None, -30.0, None, 0.0, 0.0),
    (101, None, -1.0, -1.0, 10.0, None),
]


def test_installments(spark):
    df = spark.createDataFrame(INS, "SK_ID_CURR bigint, NUM_INSTALMENT_VERSION double, DAYS_INSTALMENT double, "
                                    "DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double")
    rows = {r.SK_ID_CURR: r for r in C.installments_payments(df).collect()}
    r = rows[100]
    assert r.INSTAL_DPD_MAX == 5.0 and r.INSTAL_DBD_MAX == 5.0 and r.INSTAL_DPD_SUM == 5.0
    assert r.INSTAL_PAYMENT_PERC_MAX == math.inf   # 10 / 0; 0 / 0 is missing
    assert r.INSTAL_NUM_INSTALMENT_VERSION_NUNIQUE == 2 and r.INSTAL_COUNT == 3
    assert rows[101].INSTAL_NUM_INSTALMENT_VERSION_NUNIQUE == 0
    assert rows[101].INSTAL_AMT_PAYMENT_SUM == 0.0 and rows[101].INSTAL_AMT_PAYMENT_MEAN is None


def test_pos_cc_prev_and_feature_table(spark, app, bureau):
    pos = spark.createDataFrame([(100, 7, -1, 0, 0, "Active"), (100, 7, -2, 3, 1, None), (101, 8, -1, 0, 0, "Completed")],
                                "SK_ID_CURR bigint, SK_ID_PREV bigint, MONTHS_BALANCE bigint, SK_DPD bigint, "
                                "SK_DPD_DEF bigint, NAME_CONTRACT_STATUS string")
    p = {r.SK_ID_CURR: r for r in C.pos_cash(pos).collect()}
    assert p[100].POS_COUNT == 2 and p[100].POS_MONTHS_BALANCE_SIZE == 2
    assert p[100].POS_NAME_CONTRACT_STATUS_nan_MEAN == 0.5
    cc = spark.createDataFrame([(100, 9, 10.0, "Active"), (100, 9, None, "Active")],
                               "SK_ID_CURR bigint, SK_ID_PREV bigint, AMT_BALANCE double, NAME_CONTRACT_STATUS string")
    c = C.credit_card_balance(cc)
    assert "CC_SK_ID_PREV_MIN" not in c.columns
    r = c.first()
    assert r.CC_AMT_BALANCE_SUM == 10.0 and r.CC_AMT_BALANCE_VAR is None and r.CC_COUNT == 2
    assert r.CC_NAME_CONTRACT_STATUS_Active_MAX == 1 and r.CC_NAME_CONTRACT_STATUS_nan_SUM == 0
    prev = spark.createDataFrame(
        [(100, 1, "Approved", 1000.0, 800.0, 365243.0, -10), (100, 2, "Refused", 500.0, 0.0, -5.0, -20)],
        "SK_ID_CURR bigint, SK_ID_PREV bigint, NAME_CONTRACT_STATUS string, AMT_APPLICATION double, "
        "AMT_CREDIT double, DAYS_FIRST_DUE double, DAYS_DECISION bigint")
    spec = {"AMT_APPLICATION": ["min", "max", "mean"], "APP_CREDIT_PERC": ["min", "max", "mean", "var"],
            "DAYS_DECISION": ["min", "max", "mean"], "DAYS_FIRST_DUE": ["min"]}
    pv = C.previous_applications(prev, sentinel_cols=["DAYS_FIRST_DUE"], num_aggs=spec).first()
    assert pv.PREV_APP_CREDIT_PERC_MAX == math.inf and pv.PREV_DAYS_FIRST_DUE_MIN == -5.0
    assert pv.APPROVED_APP_CREDIT_PERC_MEAN == 1.25 and pv.REFUSED_AMT_APPLICATION_MAX == 500.0
    ft = C.feature_table(app, [bureau, C.pos_cash(pos)])
    assert ft.count() == app.count() == ft.select("SK_ID_CURR").distinct().count()
    assert "NAME_CONTRACT_TYPE_Cashloans" in ft.columns   # names cleaned
    r = {x.SK_ID_CURR: x for x in ft.collect()}[200]
    assert r.BURO_DAYS_CREDIT_MIN is None and r.POS_COUNT is None   # no children


def test_csv_null_tokens(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("k,s,x\n1,NA,1.5\n2,,NaN\n3,NULL,nan\n4,ok,\n5,nan,2\n")
    df = read_csv(spark, str(p), "k bigint, s string, x double")
    rows = {r.k: (r.s, r.x) for r in df.collect()}
    assert rows == {1: (None, 1.5), 2: (None, None), 3: (None, None), 4: ("ok", None), 5: (None, 2.0)}


def test_csv_cells_as_pandas_reads_them(spark, tmp_path):
    from riskloom.sources.csv import write_csv
    p = tmp_path / "q.csv"
    p.write_text('k,s,x,d\n2.0,"a ""b"", c",1.5,2020-01-01\n3,"line\nbreak",NA,2020-01-02\n4,plain,,NA\n5,p,2.5,\n')
    rows = {r.k: (r.s, r.x) for r in read_csv(spark, str(p), "k bigint, s string, x double, d string",
                                              multi_line=True).collect()}
    assert rows == {2: ('a "b", c', 1.5), 3: ("line\nbreak", None), 4: ("plain", None), 5: ("p", 2.5)}
    found = read_csv(spark, str(p), multi_line=True)
    assert dict(found.dtypes) == {"k": "double", "s": "string", "x": "double", "d": "string"}
    bad = tmp_path / "bad.csv"
    bad.write_text("k\n1\noops\n")
    with pytest.raises(Exception, match="oops"):
        read_csv(spark, str(bad), "k bigint").collect()
    out = str(tmp_path / "out")
    write_csv(spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "k bigint, s string"), out)
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert '"say ""hi"", you"' in text


def test_factorize_train_rows_before_test_rows(spark):
    s = "SK_ID_CURR bigint, CODE_GENDER string, FLAG_OWN_CAR string, FLAG_OWN_REALTY string"
    train = spark.createDataFrame([(5, "M", "N", "Y")], s)
    test = spark.createDataFrame([(1, "F", "Y", "Y")], s)
    out = {r.SK_ID_CURR: r.CODE_GENDER for r in C.application_features(
        train, test, sentinel_cols=[], ratios={}).collect()}
    assert out == {5: 0, 1: 1}   # by key alone F would come first
