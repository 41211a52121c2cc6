import hashlib

from hopframe.engine import Engine
from hopframe.sources import transfers
from hopframe.sources.registry import Registry

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
ROWS = ["2022/09/01 00:03, 021174 ,A1,012,B1,10.5,Euro,10.5,Euro,Wire,1", "2022/09/01 00:04,012,B1,012,B2,7,Euro,7,Euro,,0", "2022/09/01 00:05,012,B2,021174,A1,1,Euro,1,Euro,ACH,0"]


def test_a_raw_file_becomes_a_graph(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("\n".join([HEAD, *ROWS]))
    names = transfers.seed(spark, str(tmp_path / "raw.csv"), str(tmp_path / "lake"))
    assert len(names) == 9
    prop = lambda **p: {"properties": p}
    engine = Engine(
        spark,
        {
            "vertices": {"Account": {"table": "aml_accounts", **prop(accountId="account_id", risk="risk_score", type="account_type")}, "Bank": {"table": "aml_banks", **prop(bankId="bank_id", country="country_code")}},
            "edges": {
                "TRANSFER": {"table": "aml_transfers", "idColumn": "id", "outColumn": "from_account_id", "inColumn": "to_account_id", "outVertexLabel": "Account", "inVertexLabel": "Account", **prop(amount="amount", isLaundering="is_laundering", format="payment_format")},
                "AT": {"table": "aml_account_bank", "idColumn": "id", "outColumn": "account_id", "inColumn": "bank_id", "outVertexLabel": "Account", "inVertexLabel": "Bank"},
            },
        },
        Registry(spark, [{"id": "lake", "path": str(tmp_path / "lake")}]),
    )
    assert engine.results("g.V().hasLabel('Account').count()") == [3]
    assert engine.results("g.V().hasLabel('Account').has('accountId','A1').repeat(out('TRANSFER')).times(3).values('accountId')") == ["A1"]
    assert engine.results("g.E().hasLabel('TRANSFER').has('isLaundering','1').values('format')") == ["Wire"]
    assert engine.results("g.V().hasLabel('Account').has('accountId','B2').out('AT').values('bankId')") == ["012"]
    h = int(hashlib.md5(b"012:B2").hexdigest(), 16)
    risk = round(0.85 + h % 15 / 100, 2) if h % 100 < 5 else round(0.71 + h % 14 / 100, 2) if h % 100 < 20 else round(0.05 + h % 65 / 100, 2)
    assert engine.results("g.V().hasLabel('Account').has('accountId','B2').project('r','t').by('risk').by('type')") == [{"r": risk, "t": "BUSINESS" if h % 3 == 0 else "PERSONAL"}]
    code = transfers.COUNTRIES[int(hashlib.md5(b"012").hexdigest(), 16) % 10][0]
    assert engine.results("g.V().hasLabel('Bank').has('bankId','012').values('country')") == [code]
    assert spark.read.parquet(f"{tmp_path}/lake/aml_alerts.parquet").count() == 2
    assert {r.payment_format for r in spark.read.parquet(f"{tmp_path}/lake/aml_transfers.parquet").collect()} == {"Wire", "UNKNOWN", "ACH"}


def test_tables_agree_on_rows_that_are_too_short_or_too_long(spark, tmp_path):
    rows = [ROWS[0], ROWS[1] + ",more,columns", "2022/09/01 00:07,012,B9", ROWS[2]]
    (tmp_path / "raw.csv").write_text("\n".join([HEAD, *rows]))
    for most, n in ((None, 3), (2, 2)):
        transfers.seed(spark, str(tmp_path / "raw.csv"), str(tmp_path / "lake"), max_rows=most)
        read = lambda t: spark.read.parquet(f"{tmp_path}/lake/{t}.parquet")
        counts = {read(t).count() for t in ("aml_normalised", "aml_transfers", "aml_transfer_channel")} | {len(read("aml_transfers").collect())}
        assert counts == {n}
        assert read("aml_transfers").select("id").distinct().count() == n
    assert read("aml_accounts").where("account_id = 'B9'").count() == 0
