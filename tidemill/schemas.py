"""Declared table shapes.

Feeds arrive as text, so their schemas are all-string; the warehouse tables and
the quality log carry real types. Key uniqueness is produced by the upserts, not
enforced by the format.
"""

from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _typed(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


MONEY = T.DecimalType(18, 2)

# Text feeds.
SALES_FEED = _text(
    "transaction_id", "transaction_timestamp", "store_id", "product_id", "quantity",
    "unit_price", "discount", "total_amount", "currency",
)
PRODUCT_FEED = _text("product_id", "product_name", "category", "brand", "unit_price", "currency")
STORE_FEED = _text("store_id", "store_name", "city", "state", "country", "region")
CUSTOMER_FILE = _text("customer_id", "first_name", "last_name", "email", "signup_date", "country")
PRODUCT_FILE = _text("product_id", "product_name", "category", "unit_price")
ORDER_FILE = _text(
    "order_id", "order_timestamp", "customer_id", "product_id", "quantity",
    "total_amount", "currency", "status",
)

# Till sales, one row per line sold.
TILL_SALES = _typed(
    transaction_id=T.LongType(), store_id=T.LongType(), store_name=T.StringType(),
    date=T.DateType(), product_id=T.LongType(), product_name=T.StringType(),
    quantity=T.IntegerType(), unit_price=T.DecimalType(12, 2), total=T.DecimalType(12, 2),
    customer_id=T.LongType(), promo_code=T.StringType(),
)

# Staging, dimensions and fact of the daily warehouse load.
STG_CUSTOMERS = _typed(
    customer_id=T.StringType(), first_name=T.StringType(), last_name=T.StringType(),
    email=T.StringType(), signup_date=T.DateType(), country=T.StringType(),
)
STG_PRODUCTS = _typed(
    product_id=T.StringType(), product_name=T.StringType(), category=T.StringType(),
    unit_price=MONEY,
)
STG_ORDERS = _typed(
    order_id=T.StringType(), order_timestamp=T.StringType(), customer_id=T.StringType(),
    product_id=T.StringType(), quantity=T.IntegerType(), total_amount=MONEY,
    currency=T.StringType(), status=T.StringType(),
)
DIM_CUSTOMERS = T.StructType(STG_CUSTOMERS.fields + [T.StructField("created_at", T.TimestampType())])
DIM_PRODUCTS = T.StructType(STG_PRODUCTS.fields + [T.StructField("created_at", T.TimestampType())])
FACT_ORDERS = _typed(
    order_id=T.StringType(), order_timestamp=T.TimestampType(), customer_id=T.StringType(),
    product_id=T.StringType(), quantity=T.IntegerType(), total_amount=MONEY,
    currency=T.StringType(), currency_mismatch_flag=T.BooleanType(), status=T.StringType(),
    created_at=T.TimestampType(),
)

QUALITY_LOG = _typed(
    run_timestamp=T.TimestampType(), layer=T.StringType(), table_name=T.StringType(),
    metric_type=T.StringType(), metric_value=T.LongType(),
)
