import pytest

from egresslens.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "tests", **{
        "spark.driver.host": "127.0.0.1", "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ev(spark):
    """Evaluate a column expression built from named text values."""
    from pyspark.sql import functions as F

    def run(build, *values, kind="string"):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {kind}" for n in names))
        return df.select(build(*[F.col(n) for n in names]).alias("x")).first()["x"]
    return run
