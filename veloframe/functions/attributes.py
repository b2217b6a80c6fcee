"""Attribute maps, route texts and references as they stand in scenario files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PT_ROUTE = "struct<transitLineId:string,transitRouteId:string,accessFacilityId:string,egressFacilityId:string,boardingTime:string>"
#: Classes by which attribute values are typed in XML; values of other classes are skipped.
CLASSES = {"java.lang.String": "string", "java.lang.Boolean": "boolean", "java.lang.Integer": "bigint", "java.lang.Long": "bigint", "java.lang.Double": "double", "java.lang.Float": "double"}
#: Of further classes only those of string maps, kept as their JSON text, by the end of their names.
MAP_CLASSES = ("PersonVehicles", "PersonVehicleTypes")


def reference(c: Column) -> Column:
    """A vehicle or facility id; empty and ``null`` are none."""
    return F.when(~F.trim(c).isin("", "null"), F.trim(c))


def modes(c: Column) -> Column:
    """A comma-separated list without blanks and empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def route_links(c: Column) -> Column:
    """Links of a route text, which may have any white space between them."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def route_text(links: Column) -> Column:
    """The other way; a route that leaves and reaches the same link without another one prints it once."""
    once = (F.size(links) == 2) & (F.get(links, F.lit(0)) == F.get(links, F.lit(1)))
    return F.when(once, F.get(links, F.lit(0))).otherwise(F.array_join(links, " "))


def pt_route(c: Column) -> Column:
    return F.from_json(c, PT_ROUTE)


def pt_route_text(route: Column) -> Column:
    return F.to_json(route)


def merged(old: Column, new: Column) -> Column:
    """A string map with the entries of another one put over it; a missing map is empty."""
    o, n = F.coalesce(old, F.expr("cast(map() as map<string,string>)")), F.coalesce(new, F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.array_contains(F.map_keys(n), k)), n)


def typed(value: Column, cls: Column) -> Column:
    """A value by its class as JSON text, null for an unknown class or a value that doesn't fit it."""
    out = F.lit(None).cast("string")
    for name, kind in CLASSES.items():
        text = F.to_json(F.struct(value.try_cast(kind).alias("v"))) if kind != "string" else F.to_json(F.struct(value.alias("v")))
        out = F.when(cls == name, F.get_json_object(text, "$.v")).otherwise(out)
    for name in MAP_CLASSES:
        out = F.when(cls.endswith("." + name), value).otherwise(out)
    return out


def attribute(attributes: Column, name: str, kind: str = "string") -> Column:
    """A typed attribute of a map, null if it is missing or of another type."""
    return F.try_element_at(attributes, F.lit(name)).try_cast(kind)


def with_default(attributes: Column, name: str, kind: str, default: object) -> Column:
    return F.coalesce(attribute(attributes, name, kind), F.lit(default).cast(kind))


def is_interaction(act_type: Column) -> Column:
    """An activity between the legs of one trip: its type has ``interaction`` anywhere in it."""
    return act_type.contains("interaction")


def is_interaction_parameter(act_type: Column) -> Column:
    """In scoring parameters: only at the end of the type."""
    return act_type.endswith("interaction")


def vehicle_of(attributes: Column, mode: str, name: str = "vehicles") -> Column:
    """The vehicle (or, by another name, vehicle type) of a person for a mode, from the JSON map in the attribute; null if there is none."""
    return F.get_json_object(F.try_element_at(attributes, F.lit(name)), f"$['{mode}']")
