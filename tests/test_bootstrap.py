from nocturne.plans import registry

registry.load()


def test_interval_rests_on_the_references_replicates(spark):
    got = registry.QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001").first()
    assert got.replicates == 1000 and got.low < got.high
