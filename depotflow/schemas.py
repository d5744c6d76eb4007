"""Column names and types of the tables, as DDL text; `columns(name)` gives the load order."""

from __future__ import annotations

from pyspark.sql import types as T

_AUDIT = "etl_loaded_at timestamp, etl_source_file string"

TABLES = {
    "dim_date": f"""date_key int, full_date date, day_of_week int, day_name string, day_of_month int,
        day_of_year int, week_of_year int, month_num int, month_name string, quarter int, year int,
        is_weekend boolean, is_month_start boolean, is_month_end boolean, is_quarter_end boolean,
        season string, {_AUDIT}""",
    "dim_warehouse": f"""warehouse_key bigint, warehouse_id string, warehouse_name string, city string,
        state string, region string, country string, timezone string, active_flag boolean, {_AUDIT}""",
    "dim_supplier": f"""supplier_key bigint, supplier_id string, supplier_name string, country string,
        category_focus string, lead_time_avg_days double, lead_time_std_days double, otif_rate double,
        fill_rate double, defect_rate double, active_flag boolean, {_AUDIT}""",
    "dim_sku": f"""sku_key bigint, sku_id string, category string, abc_class string, xyz_class string,
        unit_cost double, unit_price double, weight_kg double, volume_cbm double, storage_type string,
        supplier_id string, lead_time_days bigint, min_order_qty bigint, safety_stock_qty bigint,
        reorder_point_qty bigint, primary_warehouse string, active_flag boolean, {_AUDIT}""",
    "fact_daily_demand": f"""demand_key bigint, date_key int, sku_key bigint, warehouse_key bigint,
        abc_class string, xyz_class string, quantity_demanded bigint, quantity_fulfilled bigint,
        quantity_unfulfilled bigint, stockout_flag boolean, revenue double, fill_rate double, {_AUDIT}""",
    "fact_inventory_snapshot": f"""snapshot_key bigint, date_key int, sku_key bigint, warehouse_key bigint,
        on_hand_qty bigint, in_transit_qty bigint, committed_qty bigint, available_qty bigint,
        inventory_value double, inventory_record_accuracy double, {_AUDIT}""",
    "dim_model": f"""model_id int, model_name string, model_type string, description string,
        hyperparameters string, created_at timestamp, {_AUDIT}""",
    "fact_forecast": f"""forecast_id bigint, sku_key bigint, warehouse_key bigint, model_id int, sku_id string,
        warehouse_id string, forecast_date date, forecast_horizon_days int, forecasted_qty double,
        lower_bound double, upper_bound double, confidence_level double, generated_at timestamp, {_AUDIT}""",
    "fact_model_performance": f"""performance_id bigint, model_id int, sku_id string, abc_class string,
        evaluation_date date, train_start date, train_end date, test_start date, test_end date, mape double,
        rmse double, mae double, bias double, record_created_at timestamp, {_AUDIT}""",
    "fact_feature_store": f"""feature_id bigint, sku_id string, warehouse_id string, feature_date date,
        lag_1 double, lag_7 double, lag_14 double, lag_28 double, rolling_avg_7 double, rolling_avg_14 double,
        rolling_avg_28 double, rolling_std_7 double, rolling_std_14 double, day_of_week int, week_of_year int,
        month int, quarter int, is_weekend boolean, season string, abc_class string, xyz_class string, {_AUDIT}""",
    "dim_customer": """customer_id string, customer_type string, region string, sla_hours int,
        annual_rev_band string, active_flag boolean, contract_since date, current_rfm_segment string,
        first_order_date date, last_order_date date, lifetime_orders bigint, lifetime_revenue double,
        etl_loaded_at timestamp""",
    "fact_orders": """order_id string, customer_id string, sku_id string, warehouse_id string, order_date date,
        ship_date date, channel string, ordered_qty bigint, shipped_qty bigint, revenue double,
        on_time_flag boolean, in_full_flag boolean, otif_flag boolean, days_to_ship int,
        etl_loaded_at timestamp""",
    "fact_rfm_scores": """score_id bigint, customer_id string, scoring_date date, recency_days int,
        frequency_count bigint, monetary_value double, recency_score int, frequency_score int,
        monetary_score int, rfm_segment string, is_current_flag boolean, valid_from timestamp,
        valid_to timestamp, etl_loaded_at timestamp""",
    "dim_ab_test_registry": """test_id bigint, test_name string, hypothesis string, target_segment string,
        primary_metric string, split_ratio double, test_start_date date, test_end_date date, status string,
        created_at timestamp""",
    "fact_ab_assignments": """assignment_id bigint, customer_id string, test_name string, test_group string,
        assigned_at date, test_start_date date, test_end_date date, primary_metric_value double,
        converted_flag boolean, conversion_date date, revenue_post_assignment double""",
    "dim_location": """location_surrogate_id bigint, location_id string, warehouse_id string, zone string,
        aisle string, bay int, level int, capacity_units int, storage_type string, active_flag boolean,
        valid_from timestamp, valid_to timestamp, is_current boolean, etl_loaded_at timestamp""",
    "dim_operator": """operator_surrogate_id bigint, operator_id string, warehouse_id string,
        hire_date_cohort string, active_flag boolean, etl_loaded_at timestamp""",
    "fact_wms_tasks": """task_id string, sku_id string, location_id string, warehouse_id string,
        operator_surrogate_id bigint, task_date date, task_type string, shift string, duration_min double,
        quantity bigint, accuracy_flag boolean, error_code string, etl_loaded_at timestamp""",
    "fact_slotting_history": """slotting_id bigint, sku_id string, warehouse_id string,
        recommendation_date date, prior_zone string, recommended_zone string,
        pick_frequency_at_recommendation bigint, estimated_daily_minutes_saved double,
        implementation_status string, implementation_date date, actual_minutes_saved_post double,
        etl_loaded_at timestamp""",
    "fact_cooccurrence": """pair_id bigint, sku_id_1 string, sku_id_2 string, warehouse_id string,
        co_occurrence_count bigint, co_occurrence_window string, lift_score double,
        last_calculated_at timestamp""",
    "run_log": "step string, status string, rows_processed bigint, duration_s double, notes string, run_at timestamp, run_id bigint",
}

# Source files and the columns each must have.
REQUIRED_COLUMNS = {
    "sku_master.csv": """SKU_ID Category ABC_Class Unit_Cost Unit_Price Weight_KG Volume_CBM Storage_Type
        Supplier_ID Lead_Time_Days Min_Order_Qty Safety_Stock_Qty Reorder_Point_Qty Primary_Warehouse
        Active_Flag""".split(),
    "daily_demand.csv": """Date SKU_ID Category Warehouse_ID ABC_Class XYZ_Class Quantity_Demanded
        Quantity_Fulfilled Stockout_Flag Revenue""".split(),
    "inventory_snapshot.csv": """Snapshot_Date SKU_ID Warehouse_ID Category On_Hand_Qty In_Transit_Qty
        Committed_Qty Available_Qty Inventory_Value""".split(),
    "suppliers.csv": """Supplier_ID Supplier_Name Country Category_Focus Lead_Time_Avg_Days
        Lead_Time_Std_Days OTIF_Rate Fill_Rate Defect_Rate Active_Flag""".split(),
    "warehouse_locations.csv": """Location_ID Warehouse_ID Zone Aisle Bay Level Capacity_Units Storage_Type
        Active_Flag""".split(),
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def columns(name: str) -> list[str]:
    return schema(name).names
