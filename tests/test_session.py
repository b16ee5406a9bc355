from hazecast.session import configure


def test_generated_code_can_be_compiled(spark):
    """HotSpot interprets methods beyond 8000 bytes; a smaller limit that the session sets stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    session = spark.newSession()
    assert int(configure(session).conf.get(limit)) == 8000
    session.conf.set(limit, "4000")
    assert int(configure(session).conf.get(limit)) == 4000
