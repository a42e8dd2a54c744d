"""What the tests of several modules share."""

SMALL = "/root/testdata/sf0.001"


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
