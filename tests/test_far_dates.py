from tallyloom.plans.registry import plain


def test_years_of_five_digits_have_no_sign(spark):
    days = spark.sql("select date_add(date'1899-12-30', 2958465) as last, date_add(date'1899-12-30', 2958466) as next, date'2024-01-02' as near")
    assert tuple(plain(days).first()) == ("9999-12-31", "10000-01-01", "2024-01-02")
