"""Labels and default thresholds that results are read by."""

# customer segments, from tenure in months and total spend
VIP, REGULAR, NEW = "VIP", "REGULAR", "NEW"
MIN_MONTHS, VIP_SPEND = 12, 5000

# RFM: number of score buckets, lowest total of each segment, best first
RFM_BUCKETS = 4
RFM_CUTS = (10, 7, 5)
CHAMPION, LOYAL, AT_RISK, LOST = "CHAMPION", "LOYAL", "AT RISK", "LOST"

# ends of the two inner cost tiers; labels are built from them
COST_CUTS = (100, 499, 500, 999)

# first ages of the age groups after the youngest; labels are built from them
AGE_CUTS = (20, 30, 40, 50)

# product tiers by total sales: above HIGH_SALES, from MID_SALES, the rest
HIGH_SALES, MID_SALES = 50000, 10000
HIGH_PERFORMER, MID_PERFORMER, LOW_PERFORMER = "HIGH PERFORMER", "MID PERFORMER", "LOW PERFORMER"

# year over year by product name
ABOVE_AVG, BELOW_AVG, AT_AVG = "ABOVE AVG", "BELOW AVG", "AT AVG"
INCREASING, DECREASING, NO_CHANGE = "INCREASING", "DECREASING", "NO CHANGE"

# year over year by product key
FIRST_YEAR, GROWING, DECLINING, FLAT = "FIRST YEAR", "GROWING", "DECLINING", "FLAT"

# rows of the measure summary
TOTAL_SALES = "Total Sales"
TOTAL_QUANTITY = "Total Quantity"
AVERAGE_ORDER_VALUE = "Average Order Value"
AVERAGE_UNIT_PRICE = "Average Unit Price"
TOTAL_ORDERS = "Total Orders"
PRODUCTS_IN_DIMENSION = "Total Products (Dim)"
PRODUCTS_SOLD = "Total Products (Sold)"
CUSTOMERS_IN_DIMENSION = "Total Customers (Dim)"
CUSTOMERS_ORDERED = "Total Customers (Ordered)"
