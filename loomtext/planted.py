"""Planted models for the registered queries: their answers follow from a text's length. They run in the tasks."""


def model_a(items):
    for i in items:
        n = len(i["sentence"])
        if n % 11:
            yield {
                "key": i["key"],
                "relevant": n % 5 != 1,
                "sentiment": ("positive", "neutral", "negative", "odd")[n % 4],
                "aspects": ["food"] * (n % 3 == 0) + ["place"] * (n % 2 == 0) + ["zzz"],
                "primary_area": ("overall", "service", "", "weird")[n % 4],
            }


def model_b(items):
    for i in items:
        n = len(i["sentence"])
        if n % 13:
            yield {
                "key": i["key"],
                "relevant": n % 7 != 1,
                "sentiment": ("positive", "neutral", "negative", "negative")[n // 4 % 4],
                "aspects": ["price"] * (n % 4 == 0) + ["food"] * (n % 3 == 0),
                "primary_area": ("overall", "staff", "service")[n % 3],
            }


def judge(items):
    for i in items:
        n = len(i["sentence"])
        if n % 6:
            aspects = [] if n % 10 == 5 else ["food", "odd"] if n % 10 == 0 else ["place"]
            yield {"key": i["key"], "relevant": n % 9 != 0, "sentiment": ("negative", "mixed", "positive")[n % 3], "aspects": aspects, "chosen": "review" if n % 17 == 0 else "1", "reason": "planted"}


def grade(texts):
    if len(texts[0]) % 7 == 0:
        raise ConnectionError
    return [{"label": ("genuine_review", "uncertain", "odd")[len(t) % 3], "reason": ""} for t in texts]
