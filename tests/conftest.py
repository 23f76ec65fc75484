import pytest

from stateweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A literal table: ``frame("a int, b string", (1, "x"), ...)``."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


@pytest.fixture
def one(spark):
    """Value of one column expression, with named literals as its input."""

    def evaluate(expression, **values):
        schema = ", ".join(f"{k} string" for k in values) or "dummy string"
        df = spark.createDataFrame([tuple(values.values()) or ("x",)], schema)
        return df.select(expression.alias("v")).first()["v"]

    return evaluate
