"""The supply-chain sources, derived from the general test tables (region .. events) of one folder."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from depotflow.functions.numbers import exact
from depotflow.session import stage

# Fixed values of the bindings.
HOLDOUT_DAYS = 92
BASIS_DAYS = 180
SITES_OF_TASKS = 3
TRIAL_START = date(2000, 8, 1)
TRIAL_END = date(2001, 8, 1)


def identifier(prefix: str, number: Column) -> Column:
    """'SKU-000000000042'."""
    return F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), 12, "0"))


def money(x: Column) -> Column:
    return exact(x)


def brand_number() -> Column:
    return F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")


class TestTables:
    """Lazy views; each property is a DataFrame over the Parquet files of one folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- sites, items, suppliers ---------------------------------------------------------------------------

    @cached_property
    def sites(self) -> DataFrame:
        """One site per region."""
        name = F.col("r_name")
        return self.table("region").select(
            name.alias("warehouse_id"),
            F.concat(F.lit("Warehouse "), name).alias("warehouse_name"),
            name.alias("region"),
            F.lit(True).alias("active_flag"),
        )

    @cached_property
    def site_of_supplier(self) -> DataFrame:
        """Site of each supplier, staged: with its real size known, lines need not be shuffled to join it."""
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return stage(
            self.table("supplier")
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("warehouse_id"))
        )

    @cached_property
    def supplier_source(self) -> DataFrame:
        key = F.col("s_suppkey")
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        text = lambda c: c.cast("string")
        return self.table("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
            identifier("SUP", key).alias("Supplier_ID"),
            F.col("s_name").alias("Supplier_Name"),
            F.col("n_name").alias("Country"),
            F.col("r_name").alias("Category_Focus"),
            text(key % 12 + 3).alias("Lead_Time_Avg_Days"),
            text((key % 5) * 0.5).alias("Lead_Time_Std_Days"),
            F.when(key % 10 == 0, "n/a").otherwise(text((key % 20 + 80) / 100)).alias("OTIF_Rate"),
            text((key % 10 + 90) / 100).alias("Fill_Rate"),
            text((key % 4) / 100).alias("Defect_Rate"),
            F.when(F.col("s_acctbal") >= 0, "True").otherwise("False").alias("Active_Flag"),
        )

    @cached_property
    def item_source(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        suppliers = self.table("supplier").agg(F.count(F.lit(1))).scalar()
        storage = F.array(*[F.lit(s) for s in ("Ambient", "Bulk", "Controlled", "Hazmat")])
        regions = self.table("region").select(F.col("r_regionkey"), F.col("r_name"))
        text = lambda c: c.cast("string")
        return self.table("part").join(regions, (key % 5).cast("int") == F.col("r_regionkey"), "left").select(
            identifier("SKU", key).alias("SKU_ID"),
            F.col("p_type").alias("Category"),
            F.when(size <= 16, "A").when(size <= 33, "B").otherwise("C").alias("ABC_Class"),
            text(F.col("p_retailprice") * 0.5).alias("Unit_Cost"),
            text(F.col("p_retailprice")).alias("Unit_Price"),
            text(size * 0.25).alias("Weight_KG"),
            F.when(size == 50, "?").otherwise(text(size * 0.125)).alias("Volume_CBM"),
            F.element_at(storage, brand_number() % 4 + 1).alias("Storage_Type"),
            identifier("SUP", key % suppliers).alias("Supplier_ID"),
            F.when(size == 1, "unknown").otherwise(text(size % 30)).alias("Lead_Time_Days"),
            text(size * 10).alias("Min_Order_Qty"),
            text(size * 3).alias("Safety_Stock_Qty"),
            text(size * 5).alias("Reorder_Point_Qty"),
            F.col("r_name").alias("Primary_Warehouse"),
            F.when(size <= 40, "True").otherwise("False").alias("Active_Flag"),
        )

    # -- demand and stock ----------------------------------------------------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        """Shipped lines with their site."""
        return (
            self.table("lineitem")
            .select(
                F.to_date("l_shipdate").alias("ship_date"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
                "l_linestatus", "l_extendedprice", "l_discount",
            )
            .join(self.site_of_supplier, "l_suppkey")
        )

    @cached_property
    def ship_days(self) -> DataFrame:
        """First and last ship date; one row, staged because many plans take a bound from it."""
        day = F.to_date("l_shipdate")
        return stage(self.table("lineitem").agg(F.min(day).alias("first"), F.max(day).alias("last")))

    @cached_property
    def demand_source(self) -> DataFrame:
        """Daily demand with the columns of its source file; revenue is missing when nothing was fulfilled."""
        kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
        amount = money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
        daily = (
            self.item_lines("ship_date", "l_quantity", kept.alias("_kept"), amount.alias("_amount"))
            .groupBy("ship_date", "SKU_ID", "warehouse_id")
            .agg(
                F.sum("l_quantity").cast("bigint").alias("_demanded"),
                F.sum("_kept").cast("bigint").alias("_fulfilled"),
                F.sum("_amount").alias("_revenue"),
            )
        )
        size = F.col("p_size")
        return daily.join(self.items, "SKU_ID").select(
            F.col("ship_date").alias("Date"),
            "SKU_ID",
            F.col("p_type").alias("Category"),
            F.col("warehouse_id").alias("Warehouse_ID"),
            F.when(size <= 16, "A").when(size <= 33, "B").otherwise("C").alias("ABC_Class"),
            F.when(size % 3 == 0, "X").when(size % 3 == 1, "Y").otherwise("Z").alias("XYZ_Class"),
            F.col("_demanded").alias("Quantity_Demanded"),
            F.col("_fulfilled").alias("Quantity_Fulfilled"),
            (F.col("_fulfilled") < F.col("_demanded")).alias("Stockout_Flag"),
            F.when(F.col("_fulfilled") > 0, F.col("_revenue")).alias("Revenue"),
        )

    @property
    def items(self) -> DataFrame:
        return self.table("part").select(identifier("SKU", F.col("p_partkey")).alias("SKU_ID"), "p_type", "p_size")

    def item_lines(self, *columns: str | Column) -> DataFrame:
        """Site, item id and the given columns of the lines whose item exists.

        Where the items are too many to be broadcast, this join shuffles the lines by item id, narrow as they are, and splits a hot item;
        sums by item, the join of its attributes and the lookup of its key find them in place.
        """
        lines = self.lines.select(identifier("SKU", F.col("l_partkey")).alias("SKU_ID"), "warehouse_id", *columns)
        return lines.join(self.items.select("SKU_ID"), "SKU_ID", "left_semi")

    @cached_property
    def inventory_source(self) -> DataFrame:
        quantity = F.col("l_quantity")

        def part_of(condition: Column) -> Column:
            return F.when(condition, quantity).otherwise(0.0)

        monthly = (
            self.item_lines(
                F.last_day("ship_date").alias("day"), quantity, part_of(F.col("l_linestatus") == "O").alias("_committed"),
                part_of(F.col("l_returnflag") == "N").alias("_in_transit"), money(F.col("l_extendedprice")).alias("_value"),
            )
            .groupBy("day", "SKU_ID", "warehouse_id")
            .agg(
                F.sum(quantity).cast("bigint").alias("on_hand"),
                F.sum("_committed").cast("bigint").alias("committed"),
                F.sum("_in_transit").cast("bigint").alias("in_transit"),
                F.sum("_value").alias("value"),
            )
        )
        return monthly.join(self.items.drop("p_size"), "SKU_ID").select(
            F.col("day").alias("Snapshot_Date"),
            "SKU_ID",
            F.col("warehouse_id").alias("Warehouse_ID"),
            F.col("p_type").alias("Category"),
            F.col("on_hand").alias("On_Hand_Qty"),
            F.col("in_transit").alias("In_Transit_Qty"),
            F.col("committed").alias("Committed_Qty"),
            (F.col("on_hand") - F.col("committed")).alias("Available_Qty"),
            F.col("value").alias("Inventory_Value"),
        )

    @cached_property
    def series(self) -> DataFrame:
        """Demand per brand, site and day, dense enough for lags: 125 series."""
        parts = self.table("part").select("p_partkey", "p_brand")
        return (
            self.lines.select("ship_date", "l_partkey", "warehouse_id", "l_quantity")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(
                F.col("ship_date").alias("feature_date"), F.col("p_brand").alias("sku_id"), "warehouse_id",
                brand_class(brand_number()).alias("abc_class"),
            )
            .agg(F.sum("l_quantity").cast("bigint").alias("quantity_demanded"))
        )

    @cached_property
    def series_items(self) -> DataFrame:
        """Item dimension at brand level."""
        site = self.table("region").select("r_regionkey", "r_name")
        brands = self.table("part").select("p_brand", brand_number().alias("_no")).distinct()
        return brands.join(site, F.col("_no") % 5 == F.col("r_regionkey"), "left").select(
            F.col("p_brand").alias("sku_id"),
            F.concat(F.lit("Category "), (F.col("_no") % 4).cast("string")).alias("category"),
            brand_class(F.col("_no")).alias("abc_class"),
            F.col("r_name").alias("primary_warehouse"),
            F.lit(True).alias("active_flag"),
        )

    # -- customers and orders ------------------------------------------------------------------------------

    @cached_property
    def customer_source(self) -> DataFrame:
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        balance = F.col("c_acctbal")
        return self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
            identifier("CUST", F.col("c_custkey")).alias("Customer_ID"),
            F.col("c_mktsegment").alias("Customer_Type"),
            F.col("r_name").alias("Region"),
            (24 * (1 + F.col("n_nationkey") % 4)).cast("string").alias("SLA_Hours"),
            F.when(balance < 0, "<0").when(balance < 2500, "0-2500").when(balance < 5000, "2500-5000")
            .otherwise(">=5000").alias("Annual_Rev_Band"),
            F.when(balance >= 0, "True").otherwise("False").alias("Active_Flag"),
            F.date_sub(F.lit(date(1995, 1, 1)), F.col("n_nationkey")).cast("string").alias("Contract_Since"),
        )

    @cached_property
    def order_source(self) -> DataFrame:
        """Orders with quantities and first ship date of their lines; an order without lines has no ship date."""
        kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.to_date(F.min("l_shipdate")).alias("ship"),
            F.sum("l_quantity").cast("bigint").alias("ordered"),
            F.sum(kept).cast("bigint").alias("shipped"),
            F.min("l_partkey").alias("part"),
        )
        day = F.to_date("o_orderdate")
        on_time = F.coalesce(F.col("ship") <= F.date_add(day, 30), F.lit(False))
        in_full = F.coalesce(F.col("ordered") == F.col("shipped"), F.lit(False))
        joined = self.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return joined.select(
            identifier("ORD", F.col("o_orderkey")).alias("Order_ID"),
            day.alias("Order_Date"),
            F.col("ship").alias("Ship_Date"),
            identifier("SKU", F.col("part")).alias("SKU_ID"),
            identifier("CUST", F.col("o_custkey")).alias("Customer_ID"),
            F.lit(None).cast("string").alias("Warehouse_ID"),
            F.col("o_orderpriority").alias("Channel"),
            F.col("ordered").alias("Ordered_Qty"),
            F.col("shipped").alias("Shipped_Qty"),
            F.col("o_totalprice").alias("Revenue"),
            on_time.alias("On_Time_Flag"),
            in_full.alias("In_Full_Flag"),
            (on_time & in_full).alias("OTIF_Flag"),
        )

    @cached_property
    def repeated_order_source(self) -> DataFrame:
        """Order lines as an order file whose ids (order, line) repeat and whose customer may be unknown."""
        line = self.table("lineitem").join(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        customer = F.when(F.col("l_partkey") % 97 == 0, F.lit("CUST-?")).otherwise(identifier("CUST", F.col("o_custkey")))
        kept = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
        on_time = F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("interval 30 days")
        return line.select(
            F.concat_ws("-", identifier("ORD", F.col("l_orderkey")), F.col("l_linenumber").cast("string")).alias("Order_ID"),
            F.to_date("o_orderdate").alias("Order_Date"),
            F.to_date("l_shipdate").alias("Ship_Date"),
            identifier("SKU", F.col("l_partkey")).alias("SKU_ID"),
            customer.alias("Customer_ID"),
            identifier("SUP", F.col("l_suppkey")).alias("Warehouse_ID"),
            F.col("o_orderpriority").alias("Channel"),
            F.col("l_quantity").alias("Ordered_Qty"),
            kept.alias("Shipped_Qty"),
            F.col("l_extendedprice").alias("Revenue"),
            on_time.alias("On_Time_Flag"),
            (F.col("l_returnflag") != "R").alias("In_Full_Flag"),
            (on_time & (F.col("l_returnflag") != "R")).alias("OTIF_Flag"),
        )

    # -- warehouse -----------------------------------------------------------------------------------------

    @cached_property
    def task_source(self) -> DataFrame:
        """Events as tasks; clicks play the picks."""
        k = F.get_json_object("props", "$.k").cast("int")
        shift = F.hour("ts")
        accurate = k % 20 != 0
        return self.table("events").select(
            identifier("TASK", F.col("event_id")).alias("task_id"),
            F.to_date("ts").alias("task_date"),
            F.when(F.col("event_type") == "click", "Pick").otherwise(F.initcap("event_type")).alias("task_type"),
            F.when(shift < 8, "Night").when(shift < 16, "Morning").otherwise("Afternoon").alias("shift"),
            identifier("SKU", k).alias("sku_id"),
            F.concat(F.lit("WH-"), (F.col("user_id") % SITES_OF_TASKS).cast("string")).alias("warehouse_id"),
            identifier("EMP", F.col("user_id")).alias("operator_id"),
            F.col("value").alias("duration_min"),
            (1 + k % 10).alias("quantity"),
            accurate.alias("accuracy_flag"),
            F.when(accurate, "nan").otherwise(F.concat(F.lit("E"), (k % 5).cast("string"))).alias("error_code"),
        )

    @cached_property
    def task_sites(self) -> DataFrame:
        """The sites on record: two of the three that tasks name, so that a check against them has something to find."""
        key = F.col("r_regionkey")
        return self.table("region").filter(key < SITES_OF_TASKS - 1).select(F.concat(F.lit("WH-"), key.cast("string")).alias("warehouse_id"))

    def location_batch(self, number: int) -> DataFrame:
        """Parts as storage locations, delivered three times with changes.

        Batch 2 moves every 10th to another zone and changes the capacity of every 7th; batch 3 also flips the active
        flag of every 15th and brings newly built locations (size above 46).
        """
        key, size = F.col("p_partkey"), F.col("p_size")
        zones = F.array(*[F.lit(z) for z in ("Bulk", "Pick_Face", "Reserve")])
        moved = F.lit(number >= 2) & (key % 10 == 0)
        zone = F.element_at(zones, ((F.length("p_type") + moved.cast("int")) % 3 + 1).cast("int"))
        capacity = size * 10 + F.when(F.lit(number >= 2) & (key % 7 == 0), 5).otherwise(0)
        active = (size <= 45) != (F.lit(number >= 3) & (key % 15 == 0))
        delivered = self.table("part") if number >= 3 else self.table("part").filter(size <= 46)
        return delivered.select(
            identifier("LOC", key).alias("location_id"),
            F.concat(F.lit("WH-"), (key % SITES_OF_TASKS).cast("string")).alias("warehouse_id"),
            zone.alias("zone"),
            F.concat(F.lit("A"), (key % 20).cast("string")).alias("aisle"),
            (key % 50).cast("int").alias("bay"),
            (size % 5).cast("int").alias("level"),
            capacity.cast("int").alias("capacity_units"),
            F.when(brand_number() % 2 == 0, "Ambient").otherwise("Bulk").alias("storage_type"),
            active.alias("active_flag"),
        )


def brand_class(number: Column) -> Column:
    return F.when(number % 3 == 0, "A").when(number % 3 == 1, "B").otherwise("C")
