from tidemark.queries import likeness
from tidemark.queries.base import Base


def test_the_cube_of_features_carries_no_labels(spark):
    b = Base(spark, "/root/testdata/sf0.001")
    cube = likeness._kept_cube(b)
    assert cube.columns == ["product_id", "week", "channel", "units", "revenue", "list_revenue"]
    assert cube.count() == cube.select("product_id", "week", "channel").distinct().count() > 0
    assert likeness._attributes(b, "brand", "grp").columns == ["item", "brand", "grp"]
