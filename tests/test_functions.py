import pytest
from pyspark.sql import functions as F

from driftlens.functions import text as T


def value(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    "a, b, want",
    [("isActive", "isClicked", 0.444), ("usePageInsets", "hasNoPadding", 0.308), ("tertiaryNav", "horizontalSubnav", 0.313), ("TextVariants", "ContentVariants", 0.667), ("x", "x", 1.0), ("", "x", 0.0)],
)
def test_name_similarity(spark, a, b, want):
    assert value(spark, T.name_similarity("a", "b"), a=a, b=b) == pytest.approx(want, abs=6e-4)


def test_masks(spark):
    assert value(spark, T.mask_types("t"), t="(event: MouseEvent<HTML>) => Foo<Bar<Baz>>") == "(_p_: _T_) => _T_"
    assert value(spark, T.mask_types("t"), t="onClick") == "on_T_"
    assert value(spark, T.mask_literals("t"), t="'a' | 'b' | 'c'") == "'_V_'"


def test_names(spark):
    assert value(spark, T.pascal_to_kebab("t"), t="MenuToggle") == "menu-toggle"
    assert value(spark, T.kebab_to_camel("t"), t="aria-label-by") == "ariaLabelBy"
    assert value(spark, T.block_to_component("t"), t="menu-toggle") == "MenuToggle"
    assert value(spark, T.trailing_suffix("t"), t="global_Color") == "Color"
    assert value(spark, T.trailing_suffix("t"), t="global_COLOR") is None
    assert value(spark, T.version_prefix("t"), t="pf-v5-c-menu") == "pf-v5"
    assert value(spark, T.canonical_path("t"), t="a/deprecated/b/next/c") == "a/b/c"
    assert value(spark, T.sanitize_id("t"), t="--Foo Bar!") == "foo-bar"
    assert value(spark, T.stem("t"), t="a/b/Menu.d.ts") == "Menu"
    assert value(spark, T.first_rename("t", [("^x", "y"), ("b$", "c")]), t="ab") == "ac"
    assert value(spark, T.normal_body("t"), t="  a /* b */\n\n // c\n d") == "a\nd"


def test_alternation_quotes(spark):
    pattern = spark.range(1).select(T.alternation(F.array(F.lit("b.c"), F.lit("a"), F.lit("a")))).first()[0]
    assert pattern == r"^(a|b\.c)$"
