"""What several tests share."""

SMALL = "/root/testdata/sf0.001"


def norm(frame):
    """Rows of a pandas frame in a form that both engines share."""

    def one(v):
        import pandas as pd

        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if isinstance(v, list):
            return str(v)
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return ""
        return str(v) if isinstance(v, (bool, str)) else f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(one(v) for v in r) for r in frame.itertuples(index=False))
