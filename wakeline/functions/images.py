"""Names of container images for task instances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of data source, how it writes the double underscore, and the image it names.
KINDS = (
    ("swe-gym", "_s_", "docker.io/xingyaoww/sweb.eval.x86_64.%s:latest"),
    ("swe-bench", "_1776_", "docker.io/swebench/sweb.eval.x86_64.%s:latest"),
    ("swe-smith", "_1776_", "docker.io/jyangballin/swesmith.x86_64.%s:latest"),
)
#: An id up to its commit, as short or long as the kinds of names want it.
BASE_SHORT, BASE_LONG = r"^(.+?\.[a-f0-9]{6,8})", r"^(.+?\.[a-f0-9]{6,})"


def base_instance(instance_id: Column, pattern: str = BASE_SHORT) -> Column:
    """The id up to its commit, or the whole id."""
    return F.when(F.regexp_like(instance_id, F.lit(pattern)), F.regexp_extract(instance_id, pattern, 1)).otherwise(instance_id)


def image_name(given: Column, instance_id: Column, source: Column, keep_suffix: bool = False) -> Column:
    """The given name, or one made from the id for the first kind that the source's name contains; null for no kind.

    keep_suffix: the older form, which keeps what follows the commit.
    """
    s, made = F.lower(source), F.lit(None).cast("string")
    for kind, mark, form in reversed(KINDS):
        base = base_instance(instance_id) if kind == "swe-smith" and not keep_suffix else instance_id
        before, after = form.split("%s")
        made = F.when(F.contains(s, F.lit(kind)), F.lower(F.concat(F.lit(before), F.replace(base, F.lit("__"), F.lit(mark)), F.lit(after)))).otherwise(made)
    return F.coalesce(given, made)


def image_error(given: Column, source: Column) -> Column:
    """Why there is no name: a source of no kind, and none given; null where there is one."""
    known = F.lit(False)
    for kind, _, _ in KINDS:
        known = known | F.contains(F.lower(source), F.lit(kind))
    return F.when(given.isNull() & ~F.coalesce(known, F.lit(False)), F.concat(F.lit("Data source: "), F.coalesce(source, F.lit("")), F.lit(" is not supported")))


def cached_image_path(instance_id: Column, folder: str, template: str) -> Column:
    """Path of a cached image file; `{base}` in the template stands for the id up to its commit."""
    before, _, after = template.partition("{base}")
    base = F.lower(F.replace(base_instance(instance_id, BASE_LONG), F.lit("__"), F.lit("_1776_")))
    return F.concat(F.lit(folder.rstrip("/") + "/" + before), base, F.lit(after))
