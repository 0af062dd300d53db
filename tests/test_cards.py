import dataclasses
import datetime as dt

import pytest

from tidemark import sources
from tidemark.config import Settings
from tidemark.operators import analytics, quality
from tidemark.plans import cards
from tidemark.sources import ingest
from tidemark.tables import VersionedTable

CUSTOMERS = "id_cliente,cpf,nome,cidade,estado,renda,segmento,data_atualizacao,operacao"
ACCOUNTS = "id_conta,id_cliente,tipo_conta,status_conta,data_abertura,data_atualizacao,operacao"
CARDS = "id_cartao,id_conta,tipo_cartao,limite,status_cartao,data_atualizacao,operacao"
PAYMENTS = "id_transacao,id_cartao,data_transacao,valor,mcc,estabelecimento,canal,pais,moeda"
EVENTS = "id_evento,id_transacao,tipo_evento,severidade,data_evento"
REFUNDS = "id_estorno,id_transacao,data_estorno,motivo"


def land(folder, name, header, *lines):
    path = folder / "in" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *lines]) + "\n")


def customer(key="C1", city="Campinas", income=1000, segment="Varejo", at="2026-01-01 00:00:00", state="SP", cpf="111.222.333-44"):
    return f"{key},{cpf},Ana,{city},{state},{income},{segment},{at},I"


@pytest.fixture
def run_settings(tmp_path):
    land(tmp_path, "clientes_cdc.csv", CUSTOMERS, customer(), customer("C1", "Sao Paulo", 5000, "Alta Renda", "2026-02-01 00:00:00"), customer("C2", state="XX", cpf="1"), customer("C3", income=-5, cpf="999.888.777-66"))
    land(tmp_path, "contas_cdc.csv", ACCOUNTS, "A1,C1,CORRENTE,ATIVA,2025-01-01,2026-01-01 00:00:00,I", "A9,C9,CORRENTE,ATIVA,2025-01-01,2026-01-01 00:00:00,I")
    land(tmp_path, "cartoes_cdc.csv", CARDS, "K1,A1,CREDITO,100,ATIVO,2026-01-01 00:00:00,I")
    land(tmp_path, "transacoes/transacoes_1.csv", PAYMENTS, "T1,K1,2026-01-20 10:00:00,100.00,5411,Loja,POS,BR,BRL", "T1,K1,2026-01-20 10:00:00,100.00,5411,Loja,POS,BR,BRL", "T2,K1,2026-02-10 10:00:00,200.00,5411,Loja,APP,US,BRL", "T3,K1,2026-02-11 10:00:00,-10.00,5411,Loja,POS,BR,BRL", "T4,K9,2026-02-11 10:00:00,10.00,5411,Loja,XXX,BR,BRL")
    land(tmp_path, "eventos_risco.csv", EVENTS, "E1,T2,FRAUDE,ALTA,2026-02-11 00:00:00", "E2,T2,SUSPEITA,MEDIA,2026-02-12 00:00:00", "E3,T99,FRAUDE,ALTA,2026-02-11 00:00:00")
    land(tmp_path, "estornos.csv", REFUNDS, "R1,T99,2026-02-12 00:00:00,DUPLICIDADE")
    return Settings(base_path=str(tmp_path / "lake"), input_path=str(tmp_path / "in"), batch_id="b1", as_of=dt.date(2026, 5, 1))


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_two_batches_end_to_end(spark, run_settings, tmp_path):
    first = cards.run(spark, run_settings)
    assert [s["rows"] for s in first["bronze"]] == [4, 2, 1, 5, 3, 1]  # duplicates stay in bronze
    assert [(e["valid"], e["rejected"]) for e in first["silver"]] == [(2, 2), (1, 1), (1, 0), (3, 2), (2, 1), (0, 1)]
    fact = by(cards.gold(spark, run_settings, "gold_fato_transacao").read(), "id_transacao")
    assert set(fact) == {"T1", "T2"}
    assert (fact["T1"].cidade_cliente_na_data, fact["T2"].cidade_cliente_na_data) == ("Campinas", "Sao Paulo")
    assert (fact["T2"].severidade_maxima_risco, fact["T2"].qtd_eventos_risco, fact["T1"].severidade_maxima_risco) == ("ALTA", 2, None)
    months = by(cards.gold(spark, run_settings, "gold_cliente_mes").read(), "ano_mes")
    assert (months["2026-01"].variacao_valor_liquido_pct, months["2026-02"].variacao_valor_liquido_pct) == (None, 100.0)
    reasons = by(VersionedTable(spark, run_settings.quarantine_path("transacoes")).read(), "id_transacao")
    assert reasons["T4"][quality.REASONS] == "cartao_inexistente; canal_invalido" and reasons["T3"][quality.REASONS] == "valor_invalido"
    customers = by(cards.gold(spark, run_settings, "gold_dim_cliente").read(), "id_cliente")
    assert customers["C1"].cliente_desde == dt.datetime(2026, 1, 1) and set(customers) == {"C1"}

    # a second batch: a late payment with new columns, a refund of an old payment, and a late change of the customer
    land(tmp_path, "transacoes/transacoes_2.csv", PAYMENTS + ",device_id,ip_origem", "T5,K1,2026-03-01 10:00:00,50.00,5411,Loja,POS,BR,BRL,d1,1.2.3.4")
    land(tmp_path, "estornos.csv", REFUNDS, "R1,T99,2026-02-12 00:00:00,DUPLICIDADE", "R2,T1,2026-03-12 00:00:00,DUPLICIDADE")
    land(tmp_path, "clientes_cdc.csv", CUSTOMERS, customer("C1", "Santos", 2000, "Varejo", "2026-01-15 00:00:00"))
    second = dataclasses.replace(run_settings, batch_id="b2")
    cards.run(spark, second)
    fact = by(cards.gold(spark, second, "gold_fato_transacao").read(), "id_transacao")
    assert set(fact) == {"T1", "T2", "T5"}
    assert (fact["T1"].flag_estornada, fact["T1"].valor_liquido, fact["T1"].cidade_cliente_na_data) == (True, 0.0, "Santos")
    assert (fact["T5"].device_id, fact["T2"].device_id) == ("d1", None)
    months = by(cards.gold(spark, second, "gold_cliente_mes").read(), "ano_mes")
    assert months["2026-01"].valor_liquido == 0.0 and months["2026-02"].variacao_valor_liquido_pct is None  # the month after a changed one is made anew
    assert months["2026-02"].valor_liquido_mes_anterior == 0.0 and len(months) == 3
    versions = cards.silver(spark, second, "silver_clientes").read().orderBy("version").collect()
    assert [v.cidade for v in versions] == ["Campinas", "Santos", "Sao Paulo"] and versions[-1].is_current
    risk = by(cards.gold(spark, second, "gold_indicadores_risco").read(), "ano_mes")
    assert (risk["2026-02"].qtd_fraude, risk["2026-02"].severidade_maxima_mes, risk["2026-01"].taxa_estorno_pct) == (1, "ALTA", 100.0)
    bronze = VersionedTable(spark, second.table_path("bronze", "bronze_transacoes")).read()
    assert {r.id_transacao: r.schema_version for r in bronze.collect()} == {"T1": 1, "T2": 1, "T3": 1, "T4": 1, "T5": 2}
    assert all(r.source_file.startswith("transacoes/transacoes_") for r in bronze.collect())

    # running again changes nothing
    third = dataclasses.replace(run_settings, batch_id="b3")
    again = cards.run(spark, third)
    assert all(s["rows"] == 0 for s in again["bronze"]) and again["gold"]["gold_fato_transacao"] == 3
    assert analytics.largest_of_month(cards.gold(spark, third, "gold_fato_transacao").read(), cards.gold(spark, third, "gold_dim_cliente").read()).count() == 2
    assert "gold_fato_transacao" in cards.register_views(spark, third) and spark.sql("SELECT count(*) FROM gold_cliente_mes").first()[0] == 3
    assert "gold.gold_dim_cliente" in cards.publish(spark, third) and spark.sql("SELECT id_cliente FROM gold.gold_dim_cliente").first()[0] == "C1"


def test_full_mode_reads_all_and_keeps_one_copy(spark, run_settings):
    full = dataclasses.replace(run_settings, run_mode="full")
    spec = cards.SOURCES["transacoes"]
    for _ in range(2):
        assert ingest(spark, full, spec)["rows"] == 5
    assert VersionedTable(spark, full.table_path("bronze", spec.table)).read().count() == 5


def test_a_run_that_dies_before_it_registers_its_files(spark, run_settings, monkeypatch):
    spec, append = cards.SOURCES["transacoes"], VersionedTable.append

    def die(table, *given, **more):
        if table.path.endswith("_control"):
            raise RuntimeError("gone")
        return append(table, *given, **more)

    with monkeypatch.context() as patch:
        patch.setattr(VersionedTable, "append", die)
        with pytest.raises(RuntimeError, match="gone"):
            ingest(spark, run_settings, spec)
    assert ingest(spark, dataclasses.replace(run_settings, batch_id="b2"), spec) == {"source": "transacoes", "files": 0, "rows": 0}
    assert VersionedTable(spark, run_settings.table_path("bronze", spec.table)).read().count() == 5
    assert VersionedTable(spark, run_settings.table_path("bronze", "_control")).read().count() == 1


def test_long_files_and_headers(spark, run_settings, monkeypatch, tmp_path):
    root = run_settings.input_path
    held = lambda: {r.file: (r.file_hash, r.header) for r in sources.discover(spark, root, "*.csv").collect()}
    whole = held()
    monkeypatch.setattr(sources, "WHOLE_BYTES", 100)
    parts = held()
    assert {f: h for f, (_, h) in parts.items()} == {f: h for f, (_, h) in whole.items()} and parts == held()
    land(tmp_path, "estornos.csv", REFUNDS, "R1,T99,2026-02-12 00:00:00,DUPLICIDADE", *(f"R{k},T1,2026-02-12 00:00:00,DUPLICIDADE" for k in range(2, 9)))
    assert {f for f in parts if held()[f] != parts[f]} == {"estornos.csv"}
    monkeypatch.setattr(sources, "HEADER_BYTES", 20)
    for most in (100, 1 << 20):
        monkeypatch.setattr(sources, "WHOLE_BYTES", most)
        with pytest.raises(Exception, match="header is too long"):
            sources.discover(spark, root, "*.csv").collect()


def test_unknown_layer(spark, run_settings):
    with pytest.raises(ValueError):
        cards.run(spark, run_settings, ["platinum"])
