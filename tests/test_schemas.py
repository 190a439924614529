from vigilflow.schemas import SCHEMAS, conform, schema
from vigilflow.sources.tables import Tables


def test_domain_views_have_the_entity_columns(spark):
    domain = Tables(spark, "/root/testdata/sf0.001").domain
    for entity in SCHEMAS:
        view = getattr(domain, entity)
        assert {f.name for f in schema(entity)} == set(view.columns), entity
        assert conform(view, entity).schema.simpleString() == schema(entity).simpleString()


def test_missing_columns_become_null(spark):
    row = conform(spark.createDataFrame([("7", "x")], "id string, extra string"), "users").first()
    assert (row.id, row.username, row.is_active) == (7, None, None)
