from callgauge.operators import enrich


def test_pricing_rules(spark):
    rows = [("claude-opus-5", 1000, 500, None, None), ("claude-haiku-4-5-20251001", 1000, 0, None, 100),
            ("anthropic.claude-opus-5", 1, 1, None, None), ("us.anthropic.claude-opus-5", 1, 1, None, None),
            ("claude-opus-5", None, None, None, None), ("mystery-model", 10, 10, None, None),
            ("gpt-4.1", 1000, 1000, 0, 1000)]
    df = spark.createDataFrame(rows, "model string, input_tokens int, output_tokens int, "
                                     "cache_write_tokens int, cache_read_tokens int")
    got = [(r.model, None if r.cost_usd is None else str(r.cost_usd), r.pricing_version)
           for r in enrich.price_events(df).collect()]
    assert got[0][1] == "0.01750000"           # 1000*5e-6 + 500*25e-6
    assert got[1][1] == "0.00101000"           # dated alias -> haiku; 100 cache reads at 0.1x
    assert got[2][1] == "0.00003000"           # one leading provider prefix stripped
    assert got[3][1] is None                   # only 'us.' stripped -> unpriced
    assert got[4][1] == "0E-8" or got[4][1] == "0.00000000"  # known model, no usage -> 0
    assert got[5][1] is None and got[5][2] == "2026-07-31"   # unknown model: NULL, version stamped
    assert got[6][1] == "0.01050000"           # 2e-6*1000 + 8e-6*1000 + 0.5e-6*1000
