"""End to end on tiny CSV files shaped like the reference's eight tables."""

import os
import random

from riskloom.operators.model import GBTParams
from riskloom.plans import workflow


def _write(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def _tables(d):
    rnd = random.Random(3)
    app_h = ["SK_ID_CURR", "TARGET", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_CONTRACT_TYPE",
             "DAYS_BIRTH", "DAYS_EMPLOYED", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "CNT_FAM_MEMBERS",
             "CNT_CHILDREN", "AMT_GOODS_PRICE", "REGION_POPULATION_RELATIVE"]
    train, test = [], []
    for i in range(100, 220):
        row = [i, int(rnd.random() < 0.2), rnd.choice(["M", "F", "XNA"]), rnd.choice(["Y", "N"]),
               rnd.choice(["Y", "N"]), rnd.choice(["Cash loans", "Revolving loans"]), -rnd.randint(8000, 20000),
               rnd.choice([365243, -rnd.randint(10, 5000)]), rnd.randint(1, 9) * 10000.0,
               rnd.choice([0.0, rnd.randint(1, 50) * 10000.0]), rnd.randint(1, 9) * 1000.0, rnd.randint(1, 4) * 1.0,
               rnd.randint(0, 3), rnd.randint(1, 50) * 10000.0, round(rnd.random() / 10, 4)]
        train.append(row)
    for i in range(300, 330):
        test.append([i] + train[0][2:3] + ["N", "Y", "Cash loans", -9000, -100, 50000.0, 100000.0, 5000.0, 2.0,
                                             0, 90000.0, 0.01])
    _write(os.path.join(d, "application_train.csv"), app_h, train)
    _write(os.path.join(d, "application_test.csv"), [h for h in app_h if h != "TARGET"], test)
    bu_h = ["SK_ID_CURR", "SK_ID_BUREAU", "CREDIT_ACTIVE", "DAYS_CREDIT", "DAYS_CREDIT_ENDDATE", "DAYS_CREDIT_UPDATE",
            "CREDIT_DAY_OVERDUE", "AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT",
            "AMT_CREDIT_SUM_OVERDUE", "AMT_CREDIT_SUM_LIMIT", "AMT_ANNUITY", "CNT_CREDIT_PROLONG"]
    bu, bb, loan = [], [], 1
    for i in range(100, 220, 2):
        for _ in range(rnd.randint(1, 3)):
            bu.append([i, loan, rnd.choice(["Active", "Closed", "Sold"]), -rnd.randint(1, 2000), -rnd.randint(-500, 500),
                       -rnd.randint(1, 100), 0, None, rnd.randint(1, 90) * 1000.0, rnd.randint(0, 9) * 100.0, 0.0,
                       None, None, rnd.randint(0, 1)])
            for m in range(rnd.randint(0, 4)):
                bb.append([loan, -m, rnd.choice(["C", "0", "X", None])])
            loan += 1
    _write(os.path.join(d, "bureau.csv"), bu_h, bu)
    _write(os.path.join(d, "bureau_balance.csv"), ["SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS"], bb)
    pv_h = ["SK_ID_PREV", "SK_ID_CURR", "NAME_CONTRACT_STATUS", "AMT_ANNUITY", "AMT_APPLICATION", "AMT_CREDIT",
            "AMT_DOWN_PAYMENT", "AMT_GOODS_PRICE", "HOUR_APPR_PROCESS_START", "RATE_DOWN_PAYMENT", "DAYS_DECISION",
            "CNT_PAYMENT", "DAYS_FIRST_DRAWING", "DAYS_FIRST_DUE", "DAYS_LAST_DUE_1ST_VERSION", "DAYS_LAST_DUE",
            "DAYS_TERMINATION"]
    pv = [[j, rnd.randint(100, 219), rnd.choice(["Approved", "Refused", "Canceled"]), 1000.0, rnd.randint(1, 9) * 1000.0,
           rnd.choice([0.0, 5000.0]), None, 900.0, rnd.randint(0, 23), 0.1, -rnd.randint(1, 999), 12.0, 365243.0,
           -10.0, -5.0, 365243.0, -1.0] for j in range(1, 150)]
    _write(os.path.join(d, "previous_application.csv"), pv_h, pv)
    _write(os.path.join(d, "POS_CASH_balance.csv"),
           ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF", "NAME_CONTRACT_STATUS"],
           [[j, rnd.randint(100, 219), -rnd.randint(0, 20), rnd.randint(0, 3), 0, rnd.choice(["Active", "Completed"])]
            for j in range(300)])
    _write(os.path.join(d, "installments_payments.csv"),
           ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT",
            "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"],
           [[j, rnd.randint(100, 219), rnd.choice([1.0, 2.0, None]), 1, -rnd.randint(1, 500) * 1.0,
             rnd.choice([None, -rnd.randint(1, 500) * 1.0]), rnd.choice([0.0, 100.0]), rnd.choice([None, 50.0])]
            for j in range(400)])
    _write(os.path.join(d, "credit_card_balance.csv"),
           ["SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "AMT_BALANCE", "NAME_CONTRACT_STATUS"],
           [[j, rnd.randint(100, 219), -rnd.randint(0, 10), rnd.choice([None, 100.0, 2.5]), rnd.choice(["Active", None])]
            for j in range(200)])


def test_workflow_end_to_end(spark, tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    _tables(str(data))
    ft = workflow.features(spark, str(data))
    n_app = ft.count()
    assert n_app == ft.select("SK_ID_CURR").distinct().count()
    assert {"BURO_DAYS_CREDIT_MIN", "ACTIVE_AMT_CREDIT_SUM_SUM", "PREV_APP_CREDIT_PERC_VAR", "POS_COUNT",
            "INSTAL_DPD_MEAN", "CC_AMT_BALANCE_VAR", "CC_COUNT", "PAYMENT_RATE"} <= set(ft.columns)
    out = workflow.run(spark, str(data), str(tmp_path / "out"), params=GBTParams(max_iter=2, max_depth=2, min_child_weight=0.0),
                       sample_fraction=None, k=3, parallelism=3, smote_k=2)
    assert out["extract"].count() == n_app           # 'XNA' applicants dropped in both
    cmp = {r.metric: r for r in out["comparison"].collect()}
    assert set(cmp) == {"AUC", "accuracy"}
    assert out["null_cells"].first().null_cells > 0
    assert os.path.isdir(tmp_path / "out" / "run" / "model")
